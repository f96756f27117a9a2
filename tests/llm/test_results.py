"""Results against brute force, round trips and held-out accuracy."""

from __future__ import annotations

import hashlib
import random
import re
import tracemalloc
import zlib
from collections import Counter, defaultdict

import numpy as np
import pandas as pd
import pytest
import xxhash
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from larder.llm import mixing, packing, quality, secrets, simhash, toxicity
from larder.llm.common import ranked
from larder.llm.components import components
from larder.llm.covertree import embedding_groups
from larder.llm.forest import forest_neighbours
from larder.llm.licenses import BASE as PHRASES
from larder.llm.licenses import license_scan
from larder.llm.secrets import BASE, MORE, Segment, secret_scan, trigram_query
from larder.llm.sharding import interleaved_shards
from larder.llm.simhash import candidate_links, completed_links, deduplicated, dropped_bits, fingerprint, fingerprint_links, simhash_groups, wide_fingerprint, without_dropped
from larder.session import stored

SMALL, MIDDLE = "/root/testdata/sf0.001", "/root/testdata/sf0.1"


@pytest.fixture(scope="module")
def docs(spark):
    return spark.read.parquet(f"{SMALL}/documents.parquet")


@pytest.fixture(scope="module")
def texts(docs):
    return {r.doc_id: r.text for r in docs.collect()}


def test_license_phrases(spark, docs):
    tricky = [(-1, "MIT LICENSE mit license mit, license; the general public general public license apache-license"), (-2, "mit. apache license")]
    rows = docs.select("doc_id", "text").union(spark.createDataFrame(tricky, "doc_id long, text string"))
    lower = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    found = {r.doc_id: r for r in license_scan(rows).collect()}
    for r in rows.collect():
        words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", r.text.translate(lower))
        hits = [(i, label) for label, p in PHRASES for i in range(len(words)) if words[i : i + len(p.split())] == p.split()]
        got = found[r.doc_id]
        assert (got.n_words, got.n_base) == (len(words), len(hits))
        assert (got.first_word, got.last_word) == ((min(hits)[0], max(hits)[0]) if hits else (None, None))
        assert got.base_labels == ",".join(sorted({label for _, label in hits}))
        assert set(got.base_labels.split(",")) - {""} <= set(got.labels.split(","))
        assert 0 <= got.score <= 1
    assert found[-1].n_base == 5


def test_secret_spans(docs, texts):
    found = {r.doc_id: r for r in secret_scan(docs).collect()}
    for doc_id, text in texts.items():
        spans = []
        for k, rule in enumerate(BASE):
            spans += [(m.start(), k, m.end()) for m in re.finditer(rule.pattern, text, rule.flags) if len(m[rule.group]) >= rule.least]
        shown = ",".join(f"{BASE[k].kind}:{a}:{b}" for a, k, b in sorted(spans))
        assert found[doc_id].base_sha256 == hashlib.sha256(shown.encode()).hexdigest()


SECRETS = {
    "assign": ["api_key: 'abcdef'", "APIKEY=abcdef", 'Token" = "abc.def-'], "access": ["AKIA" + "A1" * 8], "hex": ["0123456789abcdef" * 2],
    "private_key": ["-----BEGIN RSA PRIVATE KEY-----"], "github": ["ghp_" + "a" * 36], "slack": ["xoxb-1234567890ab"],
    "jwt": ["eyJabcdefghij.eyJabcdefghij.sig"], "google": ["AIza" + "b" * 35],
}


def test_trigram_queries_never_miss():
    for rule in BASE + MORE:
        query = trigram_query(rule.pattern, rule.flags)
        wanted = {t for clause in query for option in clause for t in option}
        texts = ["nothing here", *SECRETS[rule.kind], "", "é" * 3 + SECRETS[rule.kind][0]]
        hit = Segment(texts, wanted).candidates(query).tolist()
        assert {i for i, t in enumerate(texts) if rule.spans(t)} <= set(hit)
        assert (0 not in hit) == bool(query)
    assert trigram_query("(foobar|ab)c+x?yz{2}") == []
    assert trigram_query("abcd?[xy]") == [frozenset({frozenset({b"abc", b"bcd", b"cdx"})} | {frozenset({b"abc", b"bcx"})} | {frozenset({b"abc", b"bcd", b"cdy"})} | {frozenset({b"abc", b"bcy"})})]


def test_trigrams_on_the_edge_of_a_stretch(monkeypatch):
    texts = ["", "ab", "x token=abcdef", "to", "ken", "tok" * 5, "é password: 123456"]
    wanted = {b"tok", b"oke", b"ken", b"wor", b"\xa9 p"}
    holds = {w: [i for i, t in enumerate(texts) if w in t.encode()] for w in wanted}
    for stretch in (1, 2, 3, 7, 1 << 18):
        monkeypatch.setattr(secrets, "STRETCH", stretch)
        assert {w: p.tolist() for w, p in Segment(texts, wanted).postings.items()} == holds


def test_a_segment_takes_little_more_than_its_texts():
    texts = ["nothing to hide, " * 500_000]
    tracemalloc.start()
    Segment(texts, {b"tok"})
    most = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert most < 4 * len(texts[0]) + (1 << 24)


def test_quality_holds_out(spark):
    docs, labels = (spark.read.parquet(f"{MIDDLE}/{t}.parquet") for t in ("documents", "labels"))
    held = F.col("doc_id") % 5 == 0
    scores = quality.quality_scores(docs.where(held), labels.where(~held))
    assert scores.where("expected_grade < 0 OR expected_grade > 2 OR p_clean > p_good").isEmpty()
    # Nothing to learn from: the labelled documents are not among those scored.
    assert scores.where("abs(p_good - 0.5) > 0.1").isEmpty()
    model_docs = quality.trained(docs, labels.where(~held))
    x = np.array([quality.features(r.text) for r in docs.where(held).orderBy("doc_id").select("text").collect()])
    ids = [r.doc_id for r in docs.where(held).orderBy("doc_id").select("doc_id").collect()]
    grade = {r.doc_id: r.quality for r in labels.where(held).collect()}
    tail = model_docs.tails(x)[:, 0]
    right = [(t >= 0.5) == (grade[i] == 1) for t, i in zip(tail, ids, strict=True) if i in grade]
    assert len(right) > 500 and np.mean(right) > 0.97


def test_cumulative_link_orders_grades():
    rng = np.random.default_rng(1)
    x = rng.standard_normal((3000, 4)).astype(np.float32)
    grade = np.digitize(x @ [2, -1, 0, 0] + rng.logistic(size=3000), [-1, 1])
    model = quality.fit(x, grade, 3, penalty=0)
    assert np.allclose(model.weights, [2, -1, 0, 0], atol=0.3)
    assert np.allclose(model.thresholds, [-1, 1], atol=0.3)


def test_shards_follow_the_mixture(spark, docs):
    rows = spark.createDataFrame([(i, "x" * (i % 7), "hot" if i % 3 else f"s{i % 30}") for i in range(5000)], "doc_id long, text string, source string")
    out = interleaved_shards(rows).join(rows.select("doc_id", "source"), "doc_id").toPandas()
    sizes = out.groupby("shard").size()
    assert len(sizes) == 24 and sizes.max() - sizes.min() <= 1
    assert all(sorted(g.slot) == list(range(len(g))) for _, g in out.groupby("shard"))
    for source, n in out.groupby("source").size().items():
        own = out[out.source == source].groupby("shard").size().reindex(range(24), fill_value=0)
        assert own.max() - n / 24 < 2 and n / 24 - own.min() < 2, source
    assert all(s == (i % 7) + 8 and c == zlib.crc32(b"x" * (i % 7)) for i, s, c in zip(out.doc_id, out["size"], out.text_crc32, strict=True))


def test_shards_are_reproducible(docs):
    first, again = (interleaved_shards(d).orderBy("doc_id").collect() for d in (docs, docs.repartition(7)))
    assert first == again


def test_forest_recall_and_scores(spark):
    table = spark.read.parquet(f"{MIDDLE}/embeddings.parquet")
    rows = table.orderBy("vec_id").collect()
    ids, x = np.array([r.vec_id for r in rows]), np.array([r.embedding for r in rows], dtype=float)
    for options in ({}, {"chunk": 50, "sample": 1000}):
        found = defaultdict(list)
        for r in forest_neighbours(table, **options).orderBy("query_id", "rank").collect():
            found[r.query_id].append((r.score, r.vec_id))
        hits = 0
        for q in np.flatnonzero(ids % 100 == 0):
            apart = np.sqrt(((x - x[q]) ** 2).sum(axis=1))
            best = sorted((apart[i], ids[i]) for i in range(len(ids)) if i != q)[:10]
            got = found[ids[q]]
            assert got == sorted(got) and len(got) == 10
            assert all(abs(s - apart[np.searchsorted(ids, v)]) < 1e-12 for s, v in got)
            hits += len({v for _, v in got} & {v for _, v in best})
        assert hits / (10 * len(found)) >= 0.9


def test_ids_round_trip(docs, texts):
    import public_tokenizers
    from tokenizers import Tokenizer

    own = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    own.encode_special_tokens = True
    out = defaultdict(list)
    for r in packing.packed(docs).orderBy("doc_id", "piece").collect():
        out[r.doc_id].append(r)
    sequences = defaultdict(list)
    for doc_id, text in texts.items():
        ids = np.array([*own.encode(text, add_special_tokens=False).ids, 0], dtype="<u4")
        at = 0
        for i, r in enumerate(out[doc_id]):
            assert (r.piece, r.start) == (i, at)
            assert i == 0 or r.length == 2048
            assert r.ids_crc32 == zlib.crc32(ids[at : at + r.length].tobytes())
            at += r.length
            sequences[r.sequence_id].append((r.offset, r.length))
        assert at == len(ids) and (len(out[doc_id]) == 1) == (len(ids) <= 2048)
    for parts in sequences.values():
        ends = [0, *np.cumsum([n for _, n in sorted(parts)]).tolist()]
        assert [o for o, _ in sorted(parts)] == ends[:-1] and ends[-1] <= 2048


@settings(max_examples=60, deadline=None)
@given(st.dictionaries(st.integers(1, 60), st.integers(1, 40), max_size=25))
def test_plan_places_every_item_once(counts):
    made = packing.plan(counts, 60)
    runs = defaultdict(list)
    for length, rank, first, offset in made.runs:
        runs[length].append((rank, first, offset))
    bins = defaultdict(list)
    for length, n in counts.items():
        own = sorted(runs[length])
        assert own[0][0] == 0
        for (a, first, offset), (b, _, _) in zip(own, [*own[1:], (n, 0, 0)], strict=True):
            for k in range(b - a):
                bins[first + k].append((offset, length))
    for parts in bins.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= 60 and sum(3 * n > 60 for _, n in parts) <= 2
    whole = sum(k * n for k, n in counts.items())
    # First-fit decreasing stays below this; so must this packing.
    first_fit: list[int] = []
    for k in sorted(Counter(counts).elements(), reverse=True):
        at = next((i for i, g in enumerate(first_fit) if g >= k), None)
        if at is None:
            first_fit.append(60 - k)
        else:
            first_fit[at] -= k
    assert -(-whole // 60) <= len(bins) <= len(first_fit) * 1.1 + 1


def brute_groups(items, near):
    label = list(range(len(items)))

    def find(x):
        while label[x] != x:
            x = label[x]
        return x

    for i in range(len(items)):
        for j in range(i):
            if near(items[i], items[j]):
                a, b = find(i), find(j)
                label[max(a, b)] = min(a, b)
    return [find(i) for i in range(len(items))]


def test_simhash_by_the_bit(docs, texts):
    got = {r.doc_id: r for r in simhash_groups(docs).collect()}
    ids = sorted(texts)
    values = []
    for i in ids:
        words = re.findall(r"[^\x20\x09-\x0D]+", texts[i].translate(str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")))
        shingles = [" ".join(words[k : k + 3]) for k in range(max(1, len(words) - 2))] if words else []
        hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
        value = sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))
        assert got[i].fingerprint == f"{value:016x}"
        values.append(value)
    groups = brute_groups(values, lambda a, b: (a ^ b).bit_count() <= 3)
    assert [got[i].component_id for i in ids] == [ids[g] for g in groups]
    assert fingerprint("") == 0


@pytest.mark.parametrize(("radius", "shard"), [(3, 4096), (3, 5), (8, 20)])
def test_linked_fingerprints(spark, radius, shard):
    rng = random.Random(radius * shard)
    values = [rng.getrandbits(64) for _ in range(30)]
    for v in values[:]:
        for _ in range(8):
            v ^= sum({1 << rng.randrange(64) for _ in range(rng.randint(1, radius + 2))})
            values.append(v)
    values = sorted({v - (1 << 64) if v >> 63 else v for v in values})
    links = fingerprint_links(spark.createDataFrame([(v,) for v in values], "fp long"), radius, shard)
    label = {r.node: r.component for r in components(links).collect()}
    groups = brute_groups(values, lambda a, b: ((a ^ b) & (2**64 - 1)).bit_count() <= radius)
    assert [label.get(v, v) for v in values] == [values[g] for g in groups]


def test_components_of_chains_and_stars(spark):
    rng = random.Random(5)
    names = rng.sample(range(10_000), 900)
    chain = list(zip(names[:300], names[1:300], strict=False))
    star = [(names[300], n) for n in names[301:600]]
    loose = [(rng.choice(names[600:]), rng.choice(names[600:])) for _ in range(150)]
    links = chain + star + loose + loose[:20] + [(names[700], names[700])]
    rng.shuffle(links)
    nodes = sorted({n for link in links for n in link})
    at = {n: i for i, n in enumerate(nodes)}
    near = {frozenset((at[a], at[b])) for a, b in links}
    groups = brute_groups(range(len(nodes)), lambda a, b: frozenset((a, b)) in near)
    got = {r.node: r.component for r in components(spark.createDataFrame(links, "u long, v long")).collect()}
    assert all(got.get(n, n) == nodes[g] for n, g in zip(nodes, groups, strict=True))


def test_mixing_keeps_within_one_block(spark):
    rows = [(i, "hot" if i % 3 == 0 else f"s{i % 11}") for i in range(4000)] + [(i, None) for i in range(4000, 4100)]
    docs = spark.createDataFrame(rows, "doc_id long, source string")
    for options in ({}, {"weights": {"hot": 0.6, "s1": 0.3, "": 0.1}}, {"strata": 3}):
        out = mixing.scheduled(docs, block_rows=4, frame=100, **options).toPandas()
        assert sorted(out.doc_id) == list(range(4100))
        assert ((out.mix_release <= out.mix_slot) & (out.mix_slot < out.mix_deadline)).all()
        assert out.mix_order.is_unique and out.groupby("mix_slot").size().max() <= 4
    # While every source has blocks, each has had its share of the slots to within a block.
    slots = mixing.target_slots(docs.select(F.concat(F.lit("="), "source").alias("_source")), {"hot": 0.6, "s1": 0.3, "": 0.1}, 0.5, 100, 9)
    plan = mixing.frame_schedule(slots).toPandas()
    frame = plan.frame.iloc[0]
    for _, own in plan.groupby("stratum", dropna=False):
        share = own.slots.iloc[0] / frame
        served = np.cumsum(np.isin(np.arange(frame), own["at"]))
        assert np.abs(served - share * np.arange(1, frame + 1)).max() < 1


def test_mixing_ignores_the_partitioning(docs):
    first, again = (mixing.scheduled(d).select("doc_id", "mix_order").orderBy("doc_id").collect() for d in (docs, docs.repartition(9)))
    assert first == again


@pytest.mark.parametrize("block", [4096, 40])
def test_links_of_embeddings(spark, block):
    rng = np.random.default_rng(block)
    centres = rng.standard_normal((40, 8))
    x = np.concatenate([centres + s * rng.standard_normal((40, 8)) for s in (0, 0.05, 0.2, 0.4, 0.6)])
    x = np.concatenate([x, x[:30] * 3, np.repeat(x[:1], 50, axis=0), rng.standard_normal((50, 8))])
    ids = rng.permutation(len(x))
    table = spark.createDataFrame([(int(i), v.tolist(), 0) for i, v in zip(ids, x, strict=True)], "vec_id long, embedding array<double>, label int")
    unit = x / np.linalg.norm(x, axis=1)[:, None]
    near = unit @ unit.T >= 0.9
    order = np.argsort(ids)
    near = near[order][:, order]
    np.fill_diagonal(near, False)
    groups = brute_groups(range(len(x)), lambda a, b: near[a, b])
    out = embedding_groups(table, block=block).orderBy("vec_id").collect()
    assert [r.n_links for r in out] == near.sum(axis=1).tolist()
    assert [r.component_id for r in out] == groups
    assert [r.kept for r in out] == [i == g for i, g in enumerate(groups)]


def test_toxicity_holds_out(spark):
    docs, labels = (spark.read.parquet(f"{MIDDLE}/{t}.parquet") for t in ("documents", "labels"))
    out = toxicity.toxicity_scores(docs, labels)
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) for r in out.select("doc_id", "held_out").collect())
    held = out.where("held_out").join(labels.dropDuplicates(["doc_id"]), "doc_id").toPandas()
    rank, toxic = held.score.rank(), held.toxic == 1
    area = (rank[toxic].mean() - (toxic.sum() + 1) / 2) / (~toxic).sum()
    assert area > 0.8 and held[~toxic].predicted.mean() < 0.03
    assert toxicity.learnable(labels).where(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0).isEmpty()


def test_ranks(spark):
    rows = spark.createDataFrame([(i % 3, i % 2, i) for i in range(60)], "g int, b int, v int")
    out = ranked(rows, ["g"], "b", ["v"], "r").collect()
    for g in range(3):
        own = sorted((r.b, r.v) for r in out if r.g == g)
        assert [own.index((r.b, r.v)) for r in out if r.g == g] == [r.r for r in out if r.g == g]


def five_words(text: str) -> set[str]:
    words = text.lower().split()
    return {" ".join(words[i : i + 5]) for i in range(max(1, len(words) - 4))} if words else set()


def variants(rng: random.Random, n: int, changed: int, length: int = 200) -> list[str]:
    """A text and copies of it, with ``changed`` words of their own each."""
    words = [f"w{rng.randrange(10**6)}" for _ in range(length)]
    out = [words]
    for _ in range(n):
        copy = list(words)
        for at in rng.sample(range(length), changed):
            copy[at] = f"x{rng.randrange(10**6)}"
        out.append(copy)
    return [" ".join(w) for w in out]


def test_near_copies_go_and_looser_ones_stay(spark):
    """Two changed words of 200 leave a similarity of 0.9, twelve one of 0.6."""
    rng = random.Random(5)
    groups = [(kind, variants(rng, 6, changed)) for kind, changed in (("close", 2), ("loose", 12)) for _ in range(12)]
    rows = [(i, kind, g, text) for i, (kind, g, text) in enumerate((k, g, t) for g, (k, ts) in enumerate(groups) for t in ts)]
    kept = deduplicated(spark.createDataFrame(rows, "doc_id long, kind string, g int, text string")).collect()
    texts = {r[0]: five_words(r[3]) for r in rows}
    first = {g: min(r[0] for r in rows if r[2] == g) for g in range(len(groups))}
    assert sorted(r.doc_id for r in kept if r.kind == "close") == [first[g] for g in range(12)]
    assert sum(r.kind == "loose" for r in kept) == 12 * 7
    here = {r.doc_id for r in kept}
    for doc, _, g, _ in rows:
        similar = [o for o, _, og, _ in rows if og == g and o != doc and len(texts[o] & texts[doc]) >= 0.8 * len(texts[o] | texts[doc])]
        assert doc in here or similar


@pytest.mark.parametrize("shard", [2, 7, 4096])
def test_candidates_do_not_depend_on_the_shards(spark, shard):
    """Every pair within both radii is connected, also of equal fingerprints."""
    rng = random.Random(shard)
    texts = [t for _ in range(5) for t in variants(rng, 8, 4)]
    marks = [(i, fingerprint(t, 2), *wide_fingerprint(t)) for i, t in enumerate(texts)]
    marks += [(100 + i, marks[0][1], *wide_fingerprint(t)) for i, t in enumerate(variants(rng, 8, 3))]
    signed = [(n, *(v - (1 << 64) if v >> 63 else v for v in rest)) for n, *rest in marks]
    links = candidate_links(spark.createDataFrame(signed, "node long, fp long, high long, low long"), 8, 34, shard).collect()
    group = {n: n for n, *_ in marks}

    def root(n):
        return n if group[n] == n else root(group[n])

    def bits(a, b):
        return (a[1] ^ b[1]).bit_count() <= 8 and (a[2] ^ b[2]).bit_count() + (a[3] ^ b[3]).bit_count() <= 34

    of = {m[0]: m for m in marks}
    assert all(bits(of[u], of[v]) for u, v in links)
    for u, v in links:
        group[root(u)] = root(v)
    assert all(root(a[0]) == root(b[0]) for a in marks for b in marks if bits(a, b))


def test_packing_follows_the_mixture(spark, docs):
    """Pieces of a length and the sequences are in the order of the mixture, which other weights change."""
    runs = []
    for weights in (None, {"src0": 0.9, "": 0.005}):
        mixture = mixing.ordered(docs, weights=weights)
        place = {r.doc_id: r.mix_order for r in mixture.collect()}
        out = packing.packed(mixture, order="mix_order").collect()
        heads = [place[r.doc_id] for r in sorted(out, key=lambda r: r.sequence_id) if r.offset == 0]
        assert heads == sorted(heads) and len(heads) == len({r.sequence_id for r in out}) == 1 + max(r.sequence_id for r in out)
        assert len({(r.doc_id, r.piece) for r in out}) == len(out) == packing.packed(docs).count()
        runs.append(sorted((r.doc_id, r.piece, r.sequence_id) for r in out))
    assert runs[0] != runs[1]


def test_no_task_of_packing_has_two_python_workers(spark, docs, monkeypatch):
    plans = []

    def seen(df, name):
        plans.append(df._jdf.queryExecution().executedPlan().toString())
        return stored(df, name)

    monkeypatch.setattr(packing, "stored", seen)
    out = packing.packed(docs.withColumn("mix_order", F.monotonically_increasing_id()), order="mix_order")
    plans.append(out._jdf.queryExecution().executedPlan().toString())
    tasks = [t for plan in plans for t in re.split(r"Exchange |FileScan ", plan)]
    assert max(len(re.findall(r"ArrowEvalPython|MapInPandas", t)) for t in tasks) == 1


def test_the_pipeline_has_the_mixture(spark, monkeypatch):
    import corpus_pipeline

    def numbered():
        return sorted((r.doc_id, r.piece, r.sequence_id) for r in corpus_pipeline.run(spark, SMALL).collect())

    first = numbered()
    weighed = [(n, (lambda s, d, _: mixing.ordered(d, weights={"src0": 0.9, "": 0.005})) if n == "mixing" else f) for n, f in corpus_pipeline.STAGES]
    monkeypatch.setattr(corpus_pipeline, "STAGES", weighed)
    other = numbered()
    assert [r[:2] for r in first] == [r[:2] for r in other] and first != other


def test_ids_of_texts_with_the_marker(spark):
    import public_tokenizers
    from tokenizers import Tokenizer

    own = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    mark = "<|endoftext|>"
    texts = [f"first document{mark}second one", mark, f" {mark} {mark}{mark}\n", f"<|endof{mark}text|>", "<|endoftext |>", f"é{mark}" * 900]
    rows = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    found = {(r.doc_id, r.start): (r.length, r.ids_crc32) for r in packing.packed(rows).collect()}
    for doc_id, text in enumerate(texts):
        ids = np.array([*own.encode(text, add_special_tokens=False).ids, 0], dtype="<u4")
        for (i, start), (length, crc) in found.items():
            assert i != doc_id or crc == zlib.crc32(ids[start : start + length].tobytes())
        assert sum(n for (i, _), (n, _) in found.items() if i == doc_id) == len(ids)


def test_texts_ruled_by_one_shingle_stay(spark):
    """A run of one word sets all bits of the fingerprints, whatever else a text says."""
    rng = random.Random(8)
    texts = [" ".join(["0"] * 300 + [f"w{rng.randrange(10**6)}" for _ in range(120)]) for _ in range(4)]
    texts.append(" " + texts[0].upper())
    assert len({(fingerprint(t, 2), wide_fingerprint(t)) for t in texts}) == 1
    kept = deduplicated(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()
    assert sorted(r.doc_id for r in kept) == [0, 1, 2, 3]


def unlike(rng: random.Random, n: int) -> list[str]:
    return [f"w{rng.randrange(10**9)}" for _ in range(n)]


def test_passages_added_cut_off_or_repeated(spark):
    """Pairs of 0.80 to 0.85, which two-word fingerprints miss about half the time."""
    rng = random.Random(9)
    pairs = []
    for _ in range(25):
        text = unlike(rng, 400)
        pairs.append((text, text + unlike(rng, 90)))
        pairs.append((text := unlike(rng, 1000), text[:805]))
        pairs.append((text := unlike(rng, 300), text + text[:60] * 8))
    assert all(0.8 <= len(five_words(a) & five_words(b)) / len(five_words(a) | five_words(b)) for a, b in (map(" ".join, p) for p in pairs))
    rows = [(2 * i + k, " ".join(t)) for i, p in enumerate(pairs) for k, t in enumerate(p)]
    kept = deduplicated(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted(r.doc_id for r in kept) == list(range(0, len(rows), 2))


@pytest.mark.parametrize("pivots", [0, 1, 6])
def test_links_behind_refused_ones(spark, monkeypatch, pivots):
    """All similar pairs of a key are found, also where its first node is like none of them."""
    from larder.llm import simhash

    monkeypatch.setattr(simhash, "PIVOTS", pivots)
    monkeypatch.setattr(simhash, "OPEN_PAIRS", 0)
    rng = random.Random(10)
    base = unlike(rng, 200)
    texts = [" ".join(base[:60] + unlike(rng, 140)) for _ in range(3)] + [t for _ in range(3) for t in variants(rng, 3, 2)]
    words = base[:]
    for i in range(4):  # a chain whose ends are below 0.8
        words[40 * i : 40 * i + 3] = unlike(rng, 3)
        texts.append(" ".join(words))
    rng.shuffle(texts)
    keyed = spark.createDataFrame([(i, [1, 2] if i % 2 else [1]) for i in range(len(texts))], "node long, keys array<long>")
    rows = spark.createDataFrame(list(enumerate(texts)), "node long, text string")
    label = {r.node: r.component for r in components(completed_links(spark.createDataFrame([], "u long, v long"), keyed, rows)).collect()}
    sets = [five_words(t) for t in texts]
    groups = brute_groups(sets, lambda a, b: len(a & b) >= 0.8 * len(a | b))
    assert [label.get(i, i) for i in range(len(texts))] == groups


def test_a_rare_toxic_vocabulary_is_learnt(spark):
    """One word in most toxic documents doesn't hide that of a few others."""
    rng = random.Random(12)
    plain = ["".join(rng.choices("abcdefghij", k=7)) for _ in range(400)]
    rows = []
    for i in range(2400):
        toxic = i % 3 == 0
        rare = toxic and i % 60 == 0
        words = rng.choices(plain, k=30) + ([] if not toxic else ["zyxolumqu"] * 3 if rare else ["grobnakvst"] * 3)
        rng.shuffle(words)
        rows.append((i, " ".join(words), int(toxic), rare))
    table = spark.createDataFrame(rows, "doc_id long, text string, toxic int, rare boolean")
    out = toxicity.toxicity_scores(table, table.select("doc_id", "toxic")).where("held_out").join(table.select("doc_id", "toxic", "rare"), "doc_id").toPandas()
    assert out.rare.sum() > 3 and out[out.rare].predicted.mean() > 0.9
    assert out[out.toxic == 1].predicted.mean() > 0.9 and out[out.toxic == 0].predicted.mean() < 0.05


def test_toxicity_learns_from_one_row_of_an_id(spark):
    """An id that very many rows share is one document, whichever order the rows come in."""
    docs = spark.createDataFrame([(i, f"plain words number {i} are here") for i in range(60)] + [(61, f"copy {n}") for n in range(10_000)], "doc_id long, text string")
    labels = spark.createDataFrame([(i, 1, int(i % 3 == 0)) for i in range(62)], "doc_id long, quality int, toxic int")
    first, again = ([tuple(r) for r in toxicity.sampled(d, labels).orderBy("doc_id").collect()] for d in (docs, docs.repartition(13)))
    assert first == again and len({r[0] for r in first}) == len(first) <= 62


def test_pairs_are_counted_by_groups(spark, monkeypatch):
    """Also where tasks are small and one text is in most pairs."""
    from larder.llm import simhash

    monkeypatch.setattr(simhash, "TASK_PAIRS", 8)
    rng = random.Random(4)
    words = [f"w{i}" for i in range(60)]
    texts = {0: " ".join(words)}
    for n in range(1, 40):
        own = list(words)
        for _ in range(rng.randrange(4)):
            own[rng.randrange(60)] = f"x{rng.randrange(9)}"
        texts[n] = " ".join(own[: rng.choice([60, 60, 55, 40])])
    pairs = [(0, n) for n in range(1, 40)] + [(u, v) for u in range(1, 40) for v in range(u + 1, 40) if rng.random() < 0.2]
    sets = {n: set(simhash.shingles(t, 5)) for n, t in texts.items()}
    want = {(u, v) for u, v in pairs if len(sets[u] & sets[v]) >= 0.8 * len(sets[u] | sets[v]) - 1e-9}
    links = spark.createDataFrame(pairs, "u long, v long")
    rows = spark.createDataFrame(list(texts.items()), "node long, text string")
    assert {(r.u, r.v) for r in simhash.similar_links(links, rows).collect()} == want
    assert 0 < len(want) < len(pairs)


def test_pairs_with_few_equal_keys_are_left_out(spark):
    from larder.llm import simhash

    keys = {0: range(40), 1: [*range(4), *range(100, 136)], 2: [*range(3), *range(200, 237)], 3: [0]}
    keyed = spark.createDataFrame([(n, list(k)) for n, k in keys.items()], "node long, keys array<long>")
    pairs = spark.createDataFrame([(0, 1), (0, 2), (0, 3)], "u long, v long")
    assert sorted(r.v for r in simhash.plausible(pairs, keyed).collect()) == [1, 3]


def test_unlike_texts_that_share_a_passage_are_not_counted(spark, monkeypatch):
    """A group of similarity 0.6 costs no pairs, and the near copies in it are found."""
    from larder.llm import simhash

    rng, counted, whole = random.Random(14), [], simhash.similar_links
    monkeypatch.setattr(simhash, "similar_links", lambda links, *a, **k: counted.append(links.count()) or whole(links, *a, **k))
    passage = unlike(rng, 300)
    texts = [passage + unlike(rng, 100) for _ in range(40)]
    texts += [[*t[:-4], "other"] for t in texts[:5]]
    kept = deduplicated(spark.createDataFrame([(i, " ".join(t)) for i, t in enumerate(texts)], "doc_id long, text string")).collect()
    assert sorted(r.doc_id for r in kept) == list(range(40))
    assert sum(counted) <= 10


@pytest.mark.parametrize("size", [1, 9, 400, 9000])
def test_pairs_that_may_be_similar_are_never_ruled_out(spark, size):
    """Down to exactly 0.8, also where the sets are larger than their parities."""
    from larder.llm import simhash

    rng, pairs, sketches = np.random.default_rng(size), [], []
    for i in range(40):
        own = rng.integers(0, 1 << 63, 2 * size, dtype=np.uint64)
        a, b = own[:size], own[int(size * rng.uniform(0, 0.4)) :][: int(size * rng.uniform(0.7, 1.3)) + 1]
        pairs.append((2 * i, 2 * i + 1, len(np.intersect1d(a, b)) >= 0.8 * len(np.union1d(a, b))))
        sketches += [(2 * i + k, len(s), simhash.parities(s).tolist()) for k, s in enumerate((a, b))]
    base = rng.integers(0, 1 << 63, 10 * size, dtype=np.uint64)
    pairs.append((80, 81, True))
    sketches += [(80, 9 * size, simhash.parities(base[: 9 * size]).tolist()), (81, 9 * size, simhash.parities(base[size:]).tolist())]
    links = spark.createDataFrame([(u, v) for u, v, _ in pairs], "u long, v long")
    left = {r.u for r in simhash.possible_pairs(links, spark.createDataFrame(sketches, "node long, n long, odd array<long>")).collect()}
    assert left >= {u for u, _, alike in pairs if alike}
    assert size != 400 or len(left) < 41


def test_tasks_hold_few_hashes_of_long_texts(spark, monkeypatch):
    """Few pairs of long texts are dealt to many tasks too, with the same links."""
    from larder.llm import simhash

    rng = random.Random(15)
    texts = {n: " ".join(unlike(rng, 200)) for n in range(8)}
    texts |= {n + 8: t + " more" for n, t in list(texts.items())}
    links = spark.createDataFrame([(n, m) for n in range(8) for m in (n + 8, (n + 1) % 8)], "u long, v long")
    rows = spark.createDataFrame(list(texts.items()), "node long, text string")
    monkeypatch.setattr(simhash, "TASK_HASHES", 500)
    assert sorted(tuple(r) for r in simhash.similar_links(links, rows).collect()) == [(n, n + 8) for n in range(8)]


@pytest.mark.parametrize("bits", [1, 7, 40_000, 1 << 24])
def test_dropped_rows_go_whatever_else_has_their_bit(spark, bits):
    rows = spark.range(3000).select((F.col("id") * 8_589_934_592 + F.col("id") % 7).alias("row"), F.col("id").cast("string").alias("doc"))
    for least in (0, 1, 900, 3000):
        kept = rows.where(F.pmod(F.xxhash64("doc"), F.lit(3000)) >= least).select("row")
        out = without_dropped(rows, kept, dropped_bits(rows.select("row"), kept, bits), bits)
        assert sorted(r.row for r in out.collect()) == sorted(r.row for r in kept.collect())
        assert out.columns == rows.columns


def test_texts_that_stay_are_not_shuffled(docs, conf):
    conf(autoBroadcastJoinThreshold="-1")
    plan = deduplicated(docs)._jdf.queryExecution().executedPlan().toString()
    shuffled = [p for p in plan.split("Exchange hashpartitioning")[1:] if "doc#" in p]
    assert len(shuffled) == 1 and "BroadcastHashJoin [bucket#" in shuffled[0]
    assert sum("Filter NOT" in line and "bits#" in line for line in plan.splitlines()) == 1


def test_a_task_holds_few_of_the_pairs_of_a_large_group(monkeypatch):
    random_bits = np.random.default_rng(1)
    n = 2000
    ends = random_bits.integers(0, 1 << 16, (2, n), dtype=np.int64)
    low = np.array([sum(1 << b for b in random_bits.integers(0, 40, 4).tolist()) for _ in range(n)], dtype=np.int64)
    rows = pd.DataFrame({"choice": 0, "bits": 0, "i": 0, "j": 0, "part": 0, "node": range(n), "fp": 1 << random_bits.integers(0, 60, n), "high": ends[0] & 0xFF, "low": low})
    search = simhash._candidate_searcher(8, 20)
    results = []
    for held in (1 << 40, 50_000, 100):
        monkeypatch.setattr(simhash, "HELD_PAIRS", held)
        results.append(search(rows[:400] if held == 100 else rows).to_numpy().tolist())
    monkeypatch.setattr(simhash, "HELD_PAIRS", 1 << 40)
    assert results[0] == results[1] and len(results[0]) > n / 2
    assert results[2] == search(rows[:400]).to_numpy().tolist()
    monkeypatch.undo()
    tracemalloc.start()
    search(rows)
    most = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert most < 100_000_000


def test_near_dedup_gives_the_session_its_batches_back(spark):
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(name)
    deduplicated(spark.createDataFrame([(1, "a b c")], "doc_id long, text string")).collect()
    assert spark.conf.get(name) == before


def test_the_keys_of_all_rows_are_not_broadcast(spark):
    """They look as few as the rows; with 165 of each they did not fit the driver."""
    values = spark.range(20_000).select(F.col("id").alias("node"), F.xxhash64("id").alias("fp"))
    plan = simhash._dealt(values, 8, 4096)._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastExchange" in plan
    assert not any("explode" in sent for sent in plan.split("BroadcastExchange")[1:])


def test_many_ids_are_not_broadcast(spark):
    ids = spark.range(100)
    for most, join in ((100, "BroadcastHashJoin"), (99, "SortMergeJoin")):
        joined = spark.range(1000).join(simhash.by_rows(ids, most), "id", "left_semi")
        assert join in joined._jdf.queryExecution().executedPlan().toString()
        assert joined.count() == 100


def test_many_holders_of_keys_are_merged(spark, monkeypatch):
    """And connected as they are when they are few."""
    words = [f"w{n}" for n in range(60)]
    texts = spark.createDataFrame([(n, " ".join([*words, *(f"x{n}" for _ in range(n % 2))])) for n in range(4)], "node long, text string")
    keyed = spark.createDataFrame([(n, [7, n]) for n in range(4)], "node long, keys array<long>")
    none = spark.createDataFrame([], "u long, v long")
    found, plans = [], []
    monkeypatch.setattr(simhash, "plausible", lambda pairs, every: pairs)
    for most in (1 << 20, 0):
        monkeypatch.setattr(simhash, "BROADCAST_ROWS", most)
        real = simhash.stored

        def noted(df, name, real=real):
            if name == "pairs":
                plans.append(df._jdf.queryExecution().executedPlan().toString())
            return real(df, name)

        monkeypatch.setattr(simhash, "stored", noted)
        label = {r.node: r.component for r in components(simhash.completed_links(none, keyed, texts)).collect()}
        monkeypatch.setattr(simhash, "stored", real)
        found.append(label)
    assert found == [{n: 0 for n in range(4)}] * 2
    assert "BroadcastHashJoin" in plans[0] and not any("BroadcastHashJoin" in p for p in plans[1:])

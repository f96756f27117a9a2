"""Very long runs of one character: the same results as without shortcuts, and in linear time."""

from __future__ import annotations

import random
import re
import time

import public_tokenizers
import pytest
from tokenizers import Tokenizer

from larder.llm import packing
from larder.llm.packing import encoder
from larder.llm.secrets import BASE, MORE


@pytest.fixture(scope="module")
def both():
    own = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    return encoder(), lambda text: own.encode(text, add_special_tokens=False).ids


BLANKS = [" ", "\n", "\t", "\r\n", " \n", "　", "\xa0 ", " \x85", "\x0b\x0c"]
AROUND = [("", ""), ("word", ""), ("", "word"), ("a.", " b"), ("it's", "été"), ("x", "<|endoftext|>y"), ("<|endoftext|>", "<|endoftext|>"), ("1", "'s"), ("\x1c", "\x1f")]


@pytest.mark.parametrize("blank", BLANKS)
def test_runs_of_blanks_have_the_same_ids(both, blank):
    for n in (998, 999, 1000, 1001, 1003, 4000):
        run = (blank * n)[:n]
        for before, after in AROUND:
            text = before + run + after
            assert both[0](text) == both[1](text), (before, after, n)


def test_mixed_runs(both, monkeypatch):
    """Also with runs cut out from three blanks on."""
    monkeypatch.setattr(packing, "BLANKS", re.compile(packing.BLANKS.pattern.replace("1000", "3")))
    rng = random.Random(6)
    for _ in range(300):
        text = "".join(rng.choice([" ", "  ", "\n\n\n", "\t \n", "word", "don't", "12", "é", "<|endoftext|>", "!?", "　" * 4]) for _ in range(rng.randrange(40)))
        assert both[0](text) == both[1](text)


@pytest.mark.parametrize("blank", [" ", "\n", "\t"])
def test_five_million_blanks(both, blank):
    for text in (blank * 5_000_000, "word" + blank * 5_000_000 + "word"):
        began = time.time()
        assert both[0](text) == both[1](text)
        assert time.time() - began < 60


OLD_JWT = r"eyJ[A-Za-z0-9_-]{8,}\.eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]*"


def test_tokens_in_runs_are_found_as_by_the_plain_pattern():
    rule = next(r for r in MORE if r.kind == "jwt")
    rng = random.Random(8)
    for _ in range(3000):
        text = "".join(rng.choice(["eyJ", "abcdefgh", "a", ".", ".eyJ", " ", "-_", "eyJabcdefgh"]) for _ in range(rng.randrange(14)))
        assert rule.spans(text) == [m.span() for m in re.finditer(OLD_JWT, text, re.ASCII)]


@pytest.mark.parametrize("rule", BASE + MORE, ids=lambda r: r.kind)
def test_rules_are_linear_in_runs(rule):
    for piece in ("eyJ", "eyJabcdefgh.", "ghp_", "xoxb-", "AIza", "AKIA", "token=", "a", "-----BEGIN ", "password: ", "api_key "):
        began = time.time()
        rule.spans(piece * (5_000_000 // len(piece)))
        assert time.time() - began < 10

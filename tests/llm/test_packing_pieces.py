from __future__ import annotations

import hashlib
import struct
import subprocess
import sys
import zlib
from collections import defaultdict

import numpy as np
import pytest

from tidemark.llm import packing, pieces
from tidemark.llm.queries import tokenizer_file

WORDS, MODEL = tokenizer_file("word_bpe_49k.json"), tokenizer_file("piece_bpe_32k.model")


def truth(rows):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(WORDS)
    return {d: [*t.encode(x or "", add_special_tokens=False).ids, 2] for d, x, *_ in rows}


@pytest.mark.parametrize("size", [4096, 100])
def test_packing(docs, rows, size):
    want, seen, sequences = truth(rows), defaultdict(list), defaultdict(list)
    for r in packing.pack(docs, WORDS, max_tokens=size, max_loss_tokens=size, max_segments=7).collect():
        ids = want[r.doc_id][r.start : r.start + r.length]
        assert len(ids) == r.length and zlib.crc32(struct.pack(f"<{len(ids)}I", *ids)) == r.ids_crc32 and r.doc_tokens == len(want[r.doc_id])
        seen[r.doc_id].append((r.start, r.length))
        sequences[r.sequence_id].append((r.offset, r.length))
    assert set(seen) == set(want)
    for d, parts in seen.items():  # each id in one piece
        at = 0
        for start, n in sorted(parts):
            assert start == at
            at += n
        assert at == len(want[d])
    padding = 0
    for parts in sequences.values():
        at = 0
        for offset, n in sorted(parts):
            assert offset == at
            at += n
        assert at <= size and len(parts) <= 7
        padding += 0 if at & (at - 1) == 0 else size - at
    assert padding <= 0.02 * sum(map(len, want.values()))


def test_loss_limit(spark, docs):
    from pyspark.sql import functions as F

    marked = docs.withColumn("bears", F.when(F.col("doc_id") % 3 == 0, None).otherwise(F.col("doc_id") % 2 == 0))
    got = packing.pack(marked, WORDS, max_tokens=512, max_loss_tokens=128, loss_column="bears").collect()
    loss = defaultdict(int)
    for r in got:
        loss[r.sequence_id] += r.length * (r.doc_id % 3 != 0 and r.doc_id % 2 == 0)
    assert max(loss.values()) <= 128 and all(loss[r.sequence_id] == r.loss_tokens for r in got)


@pytest.mark.parametrize("powers", [True, False])
def test_turns_under_three_limits(spark, sf, powers):
    """Turns of conversations, of which the assistant's bear loss: each limit is the one that closes some sequences, none is passed, every token is placed once."""
    turns = spark.read.parquet(f"{sf}/conversations.parquet").selectExpr("row_number() OVER (ORDER BY conv_id, turn, role, text) AS doc_id", "text", "role = 'assistant' AS bears").cache()
    limits = {"max_tokens": 160, "max_segments": 3, "max_loss_tokens": 60}
    got = packing.pack(turns, WORDS, loss_column="bears", powers=powers, **limits).collect()
    bears = {r.doc_id: bool(r.bears) for r in turns.collect()}
    parts, sums = defaultdict(list), defaultdict(lambda: np.zeros(3, int))
    for r in got:
        parts[r.doc_id].append((r.start, r.length, r.doc_tokens))
        sums[r.sequence_id] += (r.length, 1, r.length * bears[r.doc_id])
    for pieces in parts.values():
        at = 0
        for start, length, _ in sorted(pieces):
            assert start == at
            at += length
        assert at == pieces[0][2]
    assert set(parts) == set(bears)
    used = np.array(list(sums.values())) / list(limits.values())
    assert used.max() <= 1 and (used.max(0) > 0.95).all()
    totals = [int(v[0]) for v in sums.values()]
    if powers:  # nothing is padded
        assert all(n == limits["max_tokens"] or n & (n - 1) == 0 for n in totals)
    else:  # nearly as few sequences as the tightest limit allows
        least = np.array(list(sums.values())).sum(0) / list(limits.values())
        assert len(sums) <= 1.15 * least.max() + 1
    turns.unpersist()


def test_pieces(docs, rows):
    import sentencepiece

    lib = sentencepiece.SentencePieceProcessor(model_file=MODEL)
    texts = {d: t or "" for d, t, *_ in rows}
    got = {r.doc_id: r for r in pieces.encode_decode(docs, MODEL, with_ids=True).collect()}
    assert set(got) == set(texts)
    for d, text in texts.items():
        ids = lib.encode(text, add_bos=True, add_eos=True)
        assert list(got[d].ids) == ids and got[d].n_tokens == len(ids)
        assert got[d].ids_sha256 == hashlib.sha256(struct.pack(f"<{len(ids)}I", *ids)).hexdigest()
        assert got[d].decoded == lib.decode(ids) and got[d].decoded_sha256 == hashlib.sha256(lib.decode(ids).encode()).hexdigest()


def test_empty(none):
    assert packing.pack(none, WORDS).isEmpty() and pieces.encode_decode(none, MODEL).isEmpty()


def test_words_within_the_memories_are_encoded_once(monkeypatch):
    own = packing.WordTokenizer(tokenizer_file("word_bpe_49k.json"))
    learned, learn = [0], own._learn
    monkeypatch.setattr(own, "_learn", lambda words: (learned.__setitem__(0, learned[0] + len(words)), learn(words)))
    letters = str.maketrans("0123456789", "abcdefghij")
    texts = [" ".join(f"q{i}".translate(letters) for i in range(at, at + 1000)) for at in range(0, 200_000, 1000)]
    for _ in range(2):
        for text in texts:
            own.encode_batch([text])
    assert learned[0] == 200_000 and own.encode_batch(texts[:2]) == own._encode_library(texts[:2])


def test_only_distinct_words_are_cut_into_pre_tokens(monkeypatch):
    own = packing.WordTokenizer(tokenizer_file("word_bpe_49k.json"))

    class Cutter:
        cut = 0

        def findall(self, text, plain=own.words):
            self.cut += len(text)
            return plain.findall(text)

    monkeypatch.setattr(own, "words", cutter := Cutter())
    texts = ["Alpha, it's 3,000 \n\n(beta) gamma... " * 500, "", " \t", "gamma... alpha, Ünder"] * 3
    assert [own.encode_batch(texts) for _ in range(2)] == [own._encode_library(texts)] * 2
    assert 0 < cutter.cut < 200


def test_every_character_of_the_fast_way_encodes_as_the_library_does():
    own = packing.WordTokenizer(tokenizer_file("word_bpe_49k.json"))
    letters = [c for c in map(chr, range(0x250)) if own.plain.fullmatch(c)]
    texts = [f"a{c}b {c} x{c} {c}'s {c}{c}1 -{c}" for c in letters]
    assert own.fast and own.encode_batch(texts) == own._encode_library(texts)


def test_full_memories_keep_frequent_words(monkeypatch):
    monkeypatch.setattr(packing, "CACHE_WORDS", 50)
    own = packing.WordTokenizer(tokenizer_file("word_bpe_49k.json"))
    letters = str.maketrans("0123456789", "abcdefghij")
    for at in range(0, 400, 20):
        texts = [" ".join(f"q{i}, the".translate(letters) for i in range(at, at + 20)), "the end."]
        assert own.encode_batch(texts) == own._encode_library(texts)
        assert "the" in own.known or "the" in own.older
        assert max(len(own.known), len(own.older)) <= 50 + 2 * 43


HELD = """
import re, sys
import pyarrow as pa
from tidemark.llm import common, packing

words = [f"q{i}".translate(str.maketrans("0123456789", "abcdefghij")) for i in range(3000)]
batch = pa.RecordBatch.from_pydict({"text": [" ".join(words[(7 * i + j) % 3000] for j in range(600)) for i in range(2500)]})
own = packing.WordTokenizer(sys.argv[1])
own.encode_batch([" ".join(words)])
common.give_back()
open("/proc/self/clear_refs", "w").write("5")  # the peak counts from here
at = lambda k: int(re.search(k + r":\\s+(\\d+)", open("/proc/self/status").read())[1]) / 1024
before = at("VmRSS")
for block in common.text_blocks([batch], most=packing.BLOCK):
    own.encode_batch(common.texts_of(block))
print(at("VmHWM") - before)
"""


@pytest.mark.skipif(sys.platform != "linux", reason="reads /proc")
def test_encoding_a_batch_of_known_words_takes_little_memory():
    out = subprocess.run([sys.executable, "-c", HELD, WORDS], capture_output=True, text=True, check=True, cwd=packing.__file__.rsplit("/", 3)[0])
    assert float(out.stdout) < 40  # MB for 8 MB of text

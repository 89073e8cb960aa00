"""Vector bin packing of tokenised examples into training sequences.

Every sequence has three limits at once: tokens, segments (pieces) and loss-bearing
tokens. Whole sequences are cut from long examples first; the rest is packed bin by bin
with the dot-product heuristic: of the pieces that fit, take the one whose demand vector
has the largest dot product with the bin's remaining capacities, both scaled by the
limits; of equal ones, the one that came first. Where nothing fits whole, a piece is cut to
fill what is left. At the end of a task, pieces that do not fill a sequence are cut into sequences whose length is a power
of two, which need no padding.

Each task packs its own rows in pools of bounded size, so there is no shuffle, a lost
task is simply run again with the same result, and sequence ids hold the task's number.

Null and empty texts hold the end token alone. Rows are independent: repeated rows or
ids are packed as they come, each with its own end token. An empty table gives no rows.
Extra columns are ignored. A very long text gives as many pieces as it needs.
"""

from __future__ import annotations

import json
import os
import re
import zlib
from collections.abc import Iterator
from functools import cache
from itertools import chain, pairwise

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import text_blocks, texts_of, thrifty

#: Pieces that one pool of the heuristic sees, about, and words in each of a worker's two memories.
POOL, CACHE_WORDS = 768, 240_000

#: Text bytes whose words are looked up together; characters that the library gets at once, and words.
BLOCK, LIBRARY_CHARS, LEARN_WORDS = 1 << 20, 1 << 19, 20_000

SCHEMA = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, sequence_tokens long, loss_tokens long"


class WordTokenizer:
    """A tokenizers file whose words, as white space separates them, are remembered with their ids.

    A block's words are split, numbered and replaced by their ids in Arrow; Python sees each
    distinct word of a block once, and cuts only new ones into pre-tokens. When the memory is
    full it becomes the older one; words that come again move back from there, so frequent
    words stay and rare ones go. The fast way holds for texts of Latin letters without
    combining marks; the library encodes any other text itself.
    """

    #: Normalisation is the identity but for case and white space, and case is letter by letter.
    plain = re.compile(r"[\t\n\r\x20-\x7e¡-įı-ɏ]*")
    #: The file's own pre-tokens within those characters in lower case; some have theirs in the blocks behind.
    words = re.compile(r"'(?:s|t|re|ve|m|ll|d)|[a-zß-öø-ÿā-ʯⱥⱦªµº]+|[0-9²³¹¼½¾]|[^\sa-zß-öø-ÿā-ʯⱥⱦªµº0-9²³¹¼½¾]+")

    def __init__(self, path: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        vocabulary = self.library.get_vocab()
        self.ends = np.zeros(max(vocabulary.values()) + 1, bool)  # ids that end a pre-token
        self.ends[[i for piece, i in vocabulary.items() if piece.endswith("</w>")]] = True
        self.known: dict[str, bytes] = {}
        self.older: dict[str, bytes] = {}
        self.fast = False
        with open(path, encoding="utf-8") as f:
            model = json.load(f)["model"]
        if model.get("type") == "BPE" and self.ends.any():
            self.merger = self._merger(model)
            probe = "It's the WORLD'S 12 ÉÀ ß..--''  x\n\ty'll_a ¾ª×÷"
            self.fast = self._encode_fast([probe]) == self._encode_library([probe])

    @staticmethod
    def _merger(model: dict):
        """The file's merges alone, for pre-tokens between spaces; without the library's memory, as words come once."""
        from tokenizers import Tokenizer, models, pre_tokenizers

        options = {k: x for k, x in model.items() if k not in ("type", "vocab", "merges") and x is not None}
        merges = [tuple(x.split(" ") if isinstance(x, str) else x) for x in model["merges"]]
        out = Tokenizer(models.BPE(vocab=model["vocab"], merges=merges, cache_capacity=0, **options))
        out.pre_tokenizer = pre_tokenizers.Sequence([pre_tokenizers.WhitespaceSplit(), pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)])
        return out

    def _encode_library(self, texts: list[str]) -> list[bytes]:
        out: list[bytes] = []
        upto = np.cumsum([len(t) for t in texts], dtype=np.int64)
        while len(out) < len(texts):
            at = len(out)
            to = max(at + 1, int(np.searchsorted(upto, (upto[at - 1] if at else 0) + LIBRARY_CHARS, side="right")))
            out += [np.asarray(x.ids, "<u4").tobytes() for x in self.library.encode_batch_fast(texts[at:to], add_special_tokens=False)]
        return out

    def _learn(self, words: list[str]) -> None:
        """Encodes the pre-tokens as one text of space-separated words, and cuts its ids where words end."""
        ids = np.asarray(self.merger.encode_batch_fast([" ".join(words)], add_special_tokens=False)[0].ids, "<u4")
        upto = np.flatnonzero(self.ends[ids]) + 1
        if len(upto) != len(words):
            self.known.update(zip(words, self._encode_library(words), strict=True))
            return
        raw, at = ids.tobytes(), 0
        for word, to in zip(words, (4 * upto).tolist(), strict=True):
            self.known[word] = raw[at:to]
            at = to

    def _lacking(self, words: list[str]) -> list[str]:
        """Those that neither memory holds; the others are in the newer one then."""
        found = list(map(self.older.get, words))
        self.known.update((w, x) for w, x in zip(words, found, strict=True) if x is not None)
        return [w for w, x in zip(words, found, strict=True) if x is None]

    def _add(self, words: list[str]) -> None:
        """Remembers distinct words that the newer memory lacks, and the pre-tokens that they are made of."""
        lacking = self._lacking(words)
        mixed = [w for w in lacking if not w.isalpha()]
        parts = list(map(self.words.findall, mixed))
        new = set(lacking).difference(w for w, own in zip(mixed, parts, strict=True) if len(own) != 1)
        inner = set(chain.from_iterable(parts)).difference(new)
        fresh = [*new, *self._lacking([w for w in inner if w not in self.known])]
        for at in range(0, len(fresh), LEARN_WORDS):
            self._learn(fresh[at : at + LEARN_WORDS])
        get = self.known.__getitem__
        self.known.update((w, b"".join(map(get, own))) for w, own in zip(mixed, parts, strict=True) if len(own) != 1)

    def _encode_fast(self, texts: list[str]) -> list[bytes]:
        split = pc.ascii_split_whitespace(pa.array([t.lower() for t in texts], pa.large_string()))
        numbered = split.flatten().dictionary_encode()
        words = numbered.dictionary.to_numpy(zero_copy_only=False).tolist()
        ids = list(map(self.known.get, words))
        if gaps := [i for i, x in enumerate(ids) if x is None]:
            self._add([words[i] for i in gaps])
            for i in gaps:
                ids[i] = self.known[words[i]]
        if len(self.known) > CACHE_WORDS:
            self.known, self.older = {}, self.known
        placed = pa.array(ids, pa.large_binary()).take(numbered.indices)
        _, offsets, raw = placed.buffers()
        upto = np.frombuffer(offsets, np.int64)[split.offsets.to_numpy()].tolist()
        raw = memoryview(raw or b"")
        return [bytes(raw[at:to]) for at, to in pairwise(upto)]

    def encode_batch(self, texts: list[str]) -> list[bytes]:
        if not self.fast:
            return self._encode_library(texts)
        out: list[bytes] = [b""] * len(texts)
        hard = [i for i, t in enumerate(texts) if "<|" in t or not self.plain.fullmatch(t)]
        easy = sorted(set(range(len(texts))).difference(hard))
        for some, how in ((easy, self._encode_fast), (hard, self._encode_library)):
            for i, ids in zip(some, how([texts[i] for i in some]), strict=True):
                out[i] = ids
        return out


@cache
def tokenizer(path: str) -> WordTokenizer:
    return WordTokenizer(path)


class Packer:
    """Collects pieces (example, start, length, bears loss) and gives out closed sequences."""

    def __init__(self, max_tokens: int, max_segments: int, max_loss_tokens: int, powers: bool = True):
        self.limits = np.array([max_tokens, max_segments, max_loss_tokens], float)
        self.size, self.max_segments, self.max_loss, self.powers = max_tokens, max_segments, max_loss_tokens, powers
        self.pool: list[tuple[int, int, int, bool]] = []
        self.held = 0  # tokens in the pool

    def add(self, example: int, tokens: int, loss: bool) -> Iterator[list[tuple[int, int, int, bool]]]:
        """Whole sequences of the example, then pools as they fill."""
        at, most = 0, min(self.size, self.max_loss) if loss else self.size
        while tokens - at >= self.size and most == self.size:
            yield [(example, at, self.size, loss)]
            at += self.size
        while at < tokens:  # pieces that no limit forbids by itself
            n = min(most, tokens - at)
            self.pool.append((example, at, n, loss))
            self.held += n
            at += n
        if len(self.pool) >= POOL and self.held >= 4 * self.size or len(self.pool) >= POOL + self.max_segments:
            yield from self.bins(last=False)

    def bins(self, last: bool) -> Iterator[list[tuple[int, int, int, bool]]]:
        """Closed sequences; what fills no sequence stays in the pool, or with last is cut to powers of two."""
        pool = self.pool
        length = np.array([p[2] for p in pool], float)
        loss = length * np.array([p[3] for p in pool], float)
        demand = np.stack([length, np.ones(len(pool)), loss], axis=1)
        length, loss, scaled = demand[:, 0], demand[:, 2], demand / self.limits
        free = np.ones(len(pool), bool)
        while free.any():
            if not last and length[free].sum() < 4 * self.size and free.sum() < POOL:
                break  # the next pool fills these better
            left, chosen = self.limits.copy(), []
            while left[0] > 0 and left[1] > 0:
                fits = free & (length <= left[0]) & (loss <= left[2])
                if fits.any():
                    score = np.where(fits, scaled @ (left / self.limits), -1.0)
                    i = int(score.argmax())
                    free[i] = False
                    chosen.append(pool[i])
                    left -= demand[i]
                    continue
                i = int(np.where(free, length, -1).argmax()) if free.any() else -1
                room = int(min(left[0], left[2])) if i >= 0 and pool[i][3] else int(left[0])
                if i < 0 or room <= 0 or room >= demand[i, 0]:
                    break
                example, start, n, bears = pool[i]  # cut to fill
                chosen.append((example, start, room, bears))
                left -= np.array([room, 1, room * bears])
                pool[i] = (example, start + room, n - room, bears)
                demand[i] = (n - room, 1, (n - room) * bears)
                scaled[i] = demand[i] / self.limits
            used = self.size - int(left[0])
            if not self.powers or used == self.size or used & (used - 1) == 0:
                yield chosen
            else:
                yield from self._powers(chosen, used)
        self.pool = [p for p, f in zip(pool, free, strict=True) if f]
        self.held = sum(p[2] for p in self.pool)

    def _powers(self, pieces: list[tuple[int, int, int, bool]], used: int) -> Iterator[list[tuple[int, int, int, bool]]]:
        """The pieces cut into sequences of falling powers of two."""
        at = 0
        rest = list(pieces)
        while used:
            size = 1 << (used.bit_length() - 1)
            room, out = size, []
            while room:
                example, start, n, bears = rest[at]
                take = min(n, room)
                out.append((example, start, take, bears))
                room -= take
                if take == n:
                    at += 1
                else:
                    rest[at] = (example, start + take, n - take, bears)
            yield out
            used -= size


def pack(
    docs: DataFrame, tokenizer_path: str, max_tokens: int = 4096, max_segments: int = 512, max_loss_tokens: int = 4096, end_id: int = 2, loss_column: str | None = None, id_column: str = "doc_id", powers: bool = True
) -> DataFrame:
    """Sequences of at most max_tokens, max_segments and max_loss_tokens; one row per piece.

    loss_column names a boolean column (null: false) that says whether an example's tokens
    bear loss, as an assistant's turns do; without it all do. powers: a sequence that other
    limits close before it is full is cut into powers of two, which need no padding; without
    it such a sequence stays whole, so there are fewer, and the trainer pads them.
    """

    @thrifty
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        own = tokenizer(tokenizer_path)
        packer = Packer(max_tokens, max_segments, max_loss_tokens, powers)
        end = np.asarray([end_id], "<u4").tobytes()
        held: dict[int, tuple[int | None, bytes]] = {}
        owed: dict[int, int] = {}
        sequence, example = TaskContext.get().partitionId() << 40, 0

        def rows(sequences: Iterator[list[tuple[int, int, int, bool]]]) -> pa.RecordBatch:
            nonlocal sequence
            out: list[tuple] = []
            for pieces in sequences:
                offset, total, bearing = 0, sum(p[2] for p in pieces), sum(p[2] * p[3] for p in pieces)
                for key, start, n, _ in pieces:
                    doc, ids = held[key]
                    out.append((doc, start, n, zlib.crc32(ids[4 * start : 4 * (start + n)]), len(ids) // 4, sequence, offset, total, bearing))
                    offset += n
                    owed[key] -= n
                    if not owed[key]:
                        del held[key], owed[key]
                sequence += 1
            return pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in zip(*out, strict=True)] if out else [pa.array([], pa.int64())] * 9, names=[x.split()[0] for x in SCHEMA.split(", ")])

        for block in text_blocks(batches, most=BLOCK):
            bears = block.column(2).to_pylist() if loss_column else [True] * block.num_rows
            done: list = []
            for doc, ids, loss in zip(block.column(0).to_pylist(), own.encode_batch(texts_of(block)), bears, strict=True):
                held[example] = (doc, ids + end)
                owed[example] = len(ids) // 4 + 1
                done.extend(packer.add(example, owed[example], bool(loss)))
                example += 1
            if done:
                yield rows(iter(done))
        if packer.pool:
            yield rows(packer.bins(last=True))

    return docs.select(F.col(id_column).cast("long").alias("doc_id"), "text", *([loss_column] if loss_column else [])).mapInArrow(run, SCHEMA)

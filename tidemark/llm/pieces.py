"""SentencePiece encoding and decoding by a score-ordered agenda of adjacent symbol pairs.

For merge-type (BPE) vocabularies: a text is normalised, its spaces become the mark
U+2581, and its characters are merged pairwise, best score first and leftmost among
equals, until no adjacent pair is a piece. Characters without a piece fall back to bytes.
No piece of such a vocabulary holds a mark after another character (checked at load), so
no merge crosses the start of a word: words are encoded apart and each distinct word
once per cache life. Every newly encoded word of an Arrow batch is checked against the
sentencepiece library; a difference is an error, never a silent repair.

Null and empty texts give the begin and end ids alone and decode to "". Texts of any
length are encoded whole. Rows are independent, so repeats and extra columns don't matter.
"""

from __future__ import annotations

import hashlib
import heapq
import re
from collections.abc import Iterable, Iterator
from functools import cache
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from tidemark.llm.common import text_blocks, texts_of

MARK = "▁"
#: Words that a worker remembers at most.
CACHE_WORDS = 1_000_000

SCHEMA = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string"


class AgendaEncoder:
    """Encodes with a merge-type SentencePiece vocabulary."""

    def __init__(self, model_path: str, checked: bool = True):
        import sentencepiece

        self.library = sentencepiece.SentencePieceProcessor(model_file=model_path)
        lib = self.library
        self.checked = checked
        self.begin, self.end, self.unknown = lib.bos_id(), lib.eos_id(), lib.unk_id()
        self.ids: dict[str, int] = {}
        self.scores: dict[str, float] = {}
        self.byte_ids: dict[int, int] = {}
        for i in range(lib.vocab_size()):
            piece = lib.id_to_piece(i)
            if lib.is_byte(i):
                self.byte_ids[int(piece[3:-1], 16)] = i
            elif not (lib.is_control(i) or lib.is_unknown(i) or lib.is_unused(i)):
                self.ids[piece] = i
                self.scores[piece] = lib.get_score(i)
        crossing = any(re.search(f"[^{MARK}]{MARK}", p) for p in self.ids)
        self.splitter = re.compile(".+" if crossing else f"{MARK}+[^{MARK}]*|[^{MARK}]+", re.DOTALL)
        self.words: dict[str, bytes] = {}
        self.plain = all(lib.normalize(x) == MARK + x.replace(" ", MARK) for x in ("a", "  a b  c ", "éﬁ ①\n\tx"))

    def normalise(self, text: str) -> str:
        if not text:
            return ""
        return MARK + text.replace(" ", MARK) if self.plain else self.library.normalize(text)

    def merge(self, word: str) -> list[int]:
        """Ids of one normalised word: the agenda holds adjacent pairs that form a piece, best score first, leftmost among equals."""
        whole = self.ids.get(word)
        scores = self.scores
        symbols: list[str] = list(word)
        n = len(symbols)
        if n == 1 and whole is not None:
            return [whole]
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        agenda = []
        for i in range(n - 1):
            joined = symbols[i] + symbols[i + 1]
            score = scores.get(joined)
            if score is not None:
                agenda.append((-score, i, joined))
        heapq.heapify(agenda)
        while agenda:
            _, left, joined = heapq.heappop(agenda)
            right = after[left]
            if right >= n or not symbols[left] or symbols[left] + symbols[right] != joined:
                continue  # one of the two has been merged since
            symbols[left], symbols[right] = joined, ""
            beyond = after[left] = after[right]
            if beyond < n:
                before[beyond] = left
                pair = joined + symbols[beyond]
                score = scores.get(pair)
                if score is not None:
                    heapq.heappush(agenda, (-score, left, pair))
            prior = before[left]
            if prior >= 0:
                pair = symbols[prior] + joined
                score = scores.get(pair)
                if score is not None:
                    heapq.heappush(agenda, (-score, prior, pair))
        out: list[int] = []
        for s in symbols:
            if s:
                known = self.ids.get(s)
                if known is not None:
                    out.append(known)
                elif self.byte_ids:
                    out.extend(self.byte_ids[b] for b in s.encode())
                elif not out or out[-1] != self.unknown:
                    out.append(self.unknown)
        return out

    def learn(self, words: Iterable[str]) -> None:
        """Encodes words not seen before and checks them against the library."""
        if len(self.words) > CACHE_WORDS:
            self.words.clear()
        fresh = [w for w in words if w not in self.words]
        own = [self.merge(w) for w in fresh]
        if self.checked and fresh and self.plain:
            askable = [i for i, w in enumerate(fresh) if w.startswith(MARK)]
            for i, theirs in zip(askable, self.library.encode([fresh[i][1:].replace(MARK, " ") for i in askable], num_threads=1), strict=True):
                if fresh[i] != MARK and own[i] != theirs:
                    raise ValueError(f"the library encodes {fresh[i]!r} as {theirs}, not {own[i]}")
        self.words.update((w, np.asarray(ids, "<u4").tobytes()) for w, ids in zip(fresh, own, strict=True))

    def encode_batch(self, texts: list[str]) -> list[bytes]:
        """Per text its ids with begin and end, as little-endian unsigned 32-bit integers."""
        split = [self.splitter.findall(self.normalise(t)) for t in texts]
        self.learn(set(chain.from_iterable(split)))
        begin, end, get = np.asarray([self.begin], "<u4").tobytes(), np.asarray([self.end], "<u4").tobytes(), self.words.__getitem__
        return [begin + b"".join(map(get, parts)) + end for parts in split]

    def decode_batch(self, encoded: list[bytes]) -> list[str]:
        return [self.library.decode(np.frombuffer(x, "<u4").tolist()) for x in encoded]


@cache
def encoder(model_path: str) -> AgendaEncoder:
    return AgendaEncoder(model_path)


def encode_decode(docs: DataFrame, model_path: str, with_ids: bool = False) -> DataFrame:
    """One row per document: its ids' number and digest, its decoded text's digest; with_ids adds ids and decoded."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = encoder(model_path)
        for block in text_blocks(batches):
            ids = own.encode_batch(texts_of(block))
            decoded = own.decode_batch(ids)
            out = {
                "doc_id": block.column(0).cast(pa.int64()),
                "n_tokens": pa.array([len(x) // 4 for x in ids], pa.int64()),
                "ids_sha256": pa.array([hashlib.sha256(x).hexdigest() for x in ids]),
                "decoded_sha256": pa.array([hashlib.sha256(x.encode()).hexdigest() for x in decoded]),
            }
            if with_ids:
                out |= {"ids": pa.array([np.frombuffer(x, "<u4").astype("i4").tolist() for x in ids], pa.list_(pa.int32())), "decoded": pa.array(decoded, pa.string())}
            yield pa.RecordBatch.from_pydict(out)

    return docs.select("doc_id", "text").mapInArrow(run, SCHEMA + (", ids array<int>, decoded string" if with_ids else ""))

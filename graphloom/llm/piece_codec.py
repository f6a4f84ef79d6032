"""SentencePiece encoding and decoding with exact N-best segmentation.

A text's pieces form a lattice; a segmentation is a path and its score the sum of its pieces' scores. Forward Viterbi gives
every node the best score of a way to it, which is an exact heuristic for an A-star search that runs backward from the end:
paths come out in order of score, and no partial path that is not on one of the N best is ever finished.

No piece of the vocabulary holds a space mark after another character, so the lattice of a text is a chain of the lattices
of its words. Words are solved once and remembered. Of the words' second choices only the N - 1 that cost least can be on
one of the N best paths (any N - 1 single changes that cost no more come before), so the text's own search runs over those
words alone; it is the same Viterbi and A-star over the chain of their choices.

Characters that no piece has become their UTF-8 bytes, at a score below that of every piece. Decoding joins the pieces and
gives back every text that has no space mark (U+2581) of its own, which reads as a space.

Defined cases: a null or empty text has no pieces and score zero; equal scores come in the order the search meets them,
the same on every run; rows may repeat; an empty table gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

import heapq
import re
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

N_BEST = 4
SPACE = "▁"
LETTER = r"[^\W\d_²]"
#: Words that are remembered. Frequent words come early, so beyond that the newest half is forgotten.
MOST_CACHED = 500_000
#: How far below the lowest piece a byte fallback scores, for each character.
FALLBACK = 10.0

Edge = tuple[int, int, float, bytes]  # from node, to node, score, ids as little-endian 32-bit integers


def forward_scores(size: int, into: list[list[Edge]]) -> list[float]:
    """The best score of a path from node 0 to each node."""
    best = [0.0] * (size + 1)
    for node in range(1, size + 1):
        best[node] = max(best[e[0]] + e[2] for e in into[node])
    return best


def backward_astar(size: int, into: list[list[Edge]], n: int) -> list[tuple[float, list[Edge]]]:
    """The ``n`` best paths from node 0 to node ``size``, as (score, edges)."""
    best = forward_scores(size, into)
    heap: list = [(-best[size], 0, size, 0.0, None)]
    met, out = 1, []
    while heap and len(out) < n:
        _, _, node, done, tail = heapq.heappop(heap)
        if node == 0:
            path = []
            while tail:
                path.append(tail[0])
                tail = tail[1]
            out.append((done, path))
            continue
        for edge in into[node]:
            score = done + edge[2]
            heapq.heappush(heap, (-(score + best[edge[0]]), met, edge[0], score, (edge, tail)))
            met += 1
    return out


class PieceCodec:
    """Encodes and decodes with the pieces and scores of a SentencePiece model file."""

    def __init__(self, path: str):
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        ids = range(model.get_piece_size())
        self.byte_ids = {int(model.id_to_piece(i)[3:-1], 16): i for i in ids if model.is_byte(i)}
        plain = [i for i in ids if not (model.is_byte(i) or model.is_control(i) or model.is_unknown(i) or model.is_unused(i))]
        scores = {model.id_to_piece(i): (model.get_score(i), i) for i in plain}
        #: A node has its children by character, and the score and id of the piece that ends there.
        self.trie: tuple = ({}, None, b"")
        for piece, (score, i) in sorted(scores.items()):
            node = self.trie
            for c in piece[:-1]:
                node = node[0].setdefault(c, ({}, None, b""))
            node[0][piece[-1]] = (node[0].get(piece[-1], ({},))[0], score, self._pack([i]))
        self.single = {piece for piece in scores if len(piece) == 1}
        self.lowest = min(score for score, _ in scores.values()) - FALLBACK
        joined = {c for piece in scores if len(piece) > 1 for c in piece}
        alone = "".join(c for c in "\n\t\r" if c not in joined)
        if any(SPACE in piece.lstrip(SPACE) for piece in scores):
            raise ValueError("the vocabulary has pieces across words")
        # Marks that no piece has after a letter start a word of their own there.
        marks = "".join(m for m in ".,!?;:|" if not any(re.search(LETTER + re.escape(m), piece) for piece in scores))
        first = f"[^{SPACE}{re.escape(alone)}]"
        self.words = re.compile(f"[{re.escape(alone)}]|{SPACE}*{first}(?:[^{SPACE}{re.escape(alone)}{re.escape(marks)}]+|(?<!{LETTER})[{re.escape(marks)}])*|{SPACE}+")
        self.bytes_of = [b""] * len(ids)
        for piece, (_, i) in scores.items():
            self.bytes_of[i] = piece.replace(SPACE, " ").encode()
        for value, i in self.byte_ids.items():
            self.bytes_of[i] = bytes([value])
        self.cache: dict[str, tuple[bytes, float, float]] = {}

    @staticmethod
    def _pack(ids: list[int]) -> bytes:
        return np.array(ids, "<u4").tobytes()

    def _fallback(self, char: str) -> bytes:
        return self._pack([self.byte_ids[b] for b in char.encode("utf-8", "surrogatepass")])

    def lattice(self, word: str) -> list[list[Edge]]:
        """For each node, the edges that end there."""
        into: list[list[Edge]] = [[] for _ in range(len(word) + 1)]
        for start in range(len(word)):
            node = self.trie
            for end in range(start, len(word)):
                node = node[0].get(word[end])
                if node is None:
                    break
                if node[1] is not None:
                    into[end + 1].append((start, end + 1, node[1], node[2]))
            if word[start] not in self.single:
                into[start + 1].append((start, start + 1, self.lowest, self._fallback(word[start])))
        return into

    def _solve(self, word: str) -> tuple[bytes, float, float]:
        """The best ids and their score, and what the second-best path costs more (infinite if there is none)."""
        size, root, low = len(word), self.trie, -np.inf
        best, via = [low] * (size + 1), [None] * (size + 1)
        best[0] = 0.0
        edges = []
        for start in range(size):
            base, node = best[start], root
            for end in range(start, size):
                node = node[0].get(word[end])
                if node is None:
                    break
                score = node[1]
                if score is not None:
                    edges.append((start, end + 1, score))
                    if base + score > best[end + 1]:
                        best[end + 1], via[end + 1] = base + score, (start, node[2])
            if word[start] not in self.single:
                edges.append((start, start + 1, self.lowest))
                if base + self.lowest > best[start + 1]:
                    best[start + 1], via[start + 1] = base + self.lowest, (start, self._fallback(word[start]))
        path, on, end = [], set(), size
        while end:
            start, ids = via[end]
            on.add(start * (size + 1) + end)
            path.append(ids)
            end = start
        path.reverse()
        rest = [low] * size + [0.0]
        second = low
        for start, end, score in reversed(edges):
            through = score + rest[end]
            if through > rest[start]:
                rest[start] = through
            if best[start] + through > second and start * (size + 1) + end not in on:
                second = best[start] + through
        return b"".join(path), best[size], best[size] - second

    def _words(self, text: str) -> list[str]:
        return self.words.findall(SPACE + text.replace(" ", SPACE)) if text else []

    def nbest(self, text: str | None, n: int = N_BEST) -> list[tuple[float, bytes]]:
        """The ``n`` best segmentations as (score, ids packed as little-endian 32-bit integers), best first."""
        words = self._words(text or "")
        cache = self.cache
        if len(cache) > MOST_CACHED:
            for old in list(cache)[MOST_CACHED // 2 :]:
                del cache[old]
        solved = list(map(cache.get, words))
        if None in solved:
            for i, got in enumerate(solved):
                if got is None:
                    got = cache.get(words[i])
                    if got is None:
                        got = cache[words[i]] = self._solve(words[i])
                    solved[i] = got
        ids = [s[0] for s in solved]
        total = sum([s[1] for s in solved])
        out = [(total, b"".join(ids))]
        if n == 1 or not words:
            return out
        costs = [s[2] for s in solved]
        chosen = sorted(i for _, i in heapq.nsmallest(n - 1, zip(costs, range(len(words)))))
        chosen = [i for i in chosen if costs[i] != np.inf]
        into: list[list[Edge]] = [[]]
        for k, i in enumerate(chosen):
            ways = backward_astar(len(words[i]), self.lattice(words[i]), n)
            into.append([(k, k + 1, score, b"".join(e[3] for e in path)) for score, path in ways])
        base = total - sum(solved[i][1] for i in chosen)
        for score, path in backward_astar(len(chosen), into, n)[1:]:
            for i, edge in zip(chosen, path):
                ids[i] = edge[3]
            out.append((base + score, b"".join(ids)))
        return out

    def encode(self, text: str | None) -> list[int]:
        return np.frombuffer(self.nbest(text, 1)[0][1], "<u4").tolist()

    def decode_packed(self, ids: bytes) -> str:
        raw = b"".join(map(self.bytes_of.__getitem__, np.frombuffer(ids, "<u4").tolist()))
        return raw.decode("utf-8", "surrogatepass")[1:]

    def decode(self, ids: list[int]) -> str:
        return self.decode_packed(self._pack(ids))


@lru_cache(maxsize=1)
def codec_for(path: str) -> PieceCodec:
    """The codec of a model file, kept with its words for the life of the Python worker."""
    return PieceCodec(path)


def encode_pieces(docs: DataFrame, model_path: str, id_col: str = "doc_id", text_col: str = "text", n: int = N_BEST) -> DataFrame:
    """One row per input row: ``id_col`` and nbest, an array of (score, ids), best first."""
    own = docs.schema[id_col].dataType.simpleString()
    kind = pa.list_(pa.struct([("score", pa.float64()), ("ids", pa.list_(pa.int32()))]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = codec_for(model_path)
        for batch in batches:
            for at in range(0, batch.num_rows, 64):  # the ids of a few texts at a time
                part = batch.slice(at, 64)
                rows = [[{"score": s, "ids": np.frombuffer(ids, "<i4")} for s, ids in codec.nbest(t, n)] for t in part.column(1).to_pylist()]
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(rows, kind)], ["__id", "nbest"])

    rows = docs.select(F.col(id_col).alias("__id"), F.col(text_col).cast("string").alias("__text"))
    return rows.mapInArrow(run, f"__id {own}, nbest array<struct<score: double, ids: array<int>>>").withColumnRenamed("__id", id_col)


def decode_pieces(rows: DataFrame, model_path: str, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """One row per input row: ``id_col`` and text; null or empty ids give the empty text."""
    own = rows.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = codec_for(model_path)
        for batch in batches:
            texts = [codec.decode(ids) if ids else "" for ids in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string())], ["__id", "text"])

    return rows.select(F.col(id_col).alias("__id"), F.col(ids_col).alias("__ids")).mapInArrow(run, f"__id {own}, text string").withColumnRenamed("__id", id_col)


def encode_digests(docs: DataFrame, model_path: str, id_col: str = "doc_id", text_col: str = "text", n: int = N_BEST) -> DataFrame:
    """As ``encode_pieces``, without the ids: n_pieces, score, ids_crc32 of the best, nbest as score:crc32 joined by commas,
    and the text that the best decodes to."""
    own = docs.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = codec_for(model_path)
        for batch in batches:
            found = [codec.nbest(t, n) for t in batch.column(1).to_pylist()]
            columns = [
                batch.column(0),
                pa.array([len(f[0][1]) // 4 for f in found], pa.int64()),
                pa.array([f[0][0] for f in found], pa.float64()),
                pa.array([zlib.crc32(f[0][1]) for f in found], pa.int64()),
                pa.array([",".join(f"{s:.0f}:{zlib.crc32(ids)}" for s, ids in f) for f in found], pa.string()),
                pa.array([codec.decode_packed(f[0][1]) for f in found], pa.string()),
            ]
            yield pa.RecordBatch.from_arrays(columns, ["__id", "n_pieces", "score", "ids_crc32", "nbest", "decoded"])

    rows = docs.select(F.col(id_col).alias("__id"), F.col(text_col).cast("string").alias("__text"))
    return rows.mapInArrow(run, f"__id {own}, n_pieces long, score double, ids_crc32 long, nbest string, decoded string").withColumnRenamed("__id", id_col)

"""Operator 12: how many tokens a text has, by the whole-token shortcut.

Before any text is read, every string of the vocabulary is encoded alone by the vocabulary's own merges. Those that
end as one token are proved: a pre-token equal to one of them counts one, without merging. Only other pre-tokens are
merged, by rank, and counted: those that are new in a batch of texts together, as rows of a matrix of symbols.

Pre-tokens are the pattern's matches. The library's tables of characters are older than those of the pattern engine
used here, so texts with characters outside ``AGREED``, where both agree, are cut by the library itself. Strings of
the vocabulary's added tokens within a text count one token each, as the library has it by default; nothing is added,
cut off or padded.

A null or empty text has no token. Very long texts are read in runs, cut where no pre-token reaches over. Rows are
independent: ties and repeated rows give equal results, an empty table an empty table, and other columns ride along (one
named like an output column is replaced).
"""

from __future__ import annotations

import heapq
import json
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField

from gridloom.llm.bpe import Lookup
from gridloom.llm.common import read_table, texts, with_columns

#: Texts over this many tokens are marked.
LIMIT = 512
#: Characters for which pattern engine and library have the same classes (Latin, Greek, Cyrillic, general punctuation,
#: currency signs, arrows and mathematical signs, Chinese, Japanese and Korean, most pictures).
AGREED = "\x00-՗ -⁤₠-₾℀-↊←-⏲─-⭌　-〠ぁ-ゖ゠-ヾ一-鿌가-힣！-～\U0001f300-\U0001f579\U0001f600-\U0001f640"
#: Pieces other than whole tokens that a Python worker remembers, and the longest of those.
CACHE_PIECES, CACHE_CHARS = 500_000, 40
#: A text is read in runs of about so many characters.
RUN_CHARS = 1 << 20
#: Pieces of more bytes are merged by a heap; shorter ones together, in matrices of up to so many symbols.
TOGETHER_BYTES, TOGETHER_CELLS = 48, 1 << 18
_NONE = np.iinfo(np.int32).max


def byte_letters() -> list[str]:
    """The letter that stands for each byte in a byte-level vocabulary: itself if it prints, else one from 256 on."""
    prints = {*range(33, 127), *range(161, 173), *range(174, 256)}
    others = iter(range(256, 512))
    return [chr(b) if b in prints else chr(next(others)) for b in range(256)]


class TokenCounter:
    """A byte-level vocabulary with merges, from the library's file, and the strings proved to be whole tokens."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model, before = spec["model"], spec["pre_tokenizer"]
        plain = not (spec["normalizer"] or model.get("unk_token") or model.get("dropout") or model.get("ignore_merges") or model.get("continuing_subword_prefix") or model.get("end_of_word_suffix"))
        if model["type"] != "BPE" or before["type"] != "ByteLevel" or before["add_prefix_space"] or not before["use_regex"] or not plain:
            raise ValueError(f"{path} isn't a plain byte-level BPE")
        added = spec["added_tokens"]
        if any(t["single_word"] or t["lstrip"] or t["rstrip"] for t in added):
            raise ValueError("added tokens that take spaces or stand as words aren't known here")
        self.path = path
        self.added = "|".join(re.escape(t["content"]) for t in sorted(added, key=lambda t: -len(t["content"])))
        vocab = model["vocab"]
        letters = byte_letters()
        self.byte = np.array([vocab[c] for c in letters], np.int64)
        #: The rank of each pair that merges, and each rank's result.
        self.merge: dict[int, int] = {}
        pairs = [pair if isinstance(pair, list) else pair.split(" ") for pair in model["merges"]]
        self.result = np.array([vocab[a + b] for a, b in pairs], np.int64)
        for rank, (a, b) in enumerate(pairs):
            self.merge.setdefault(vocab[a] << 32 | vocab[b], rank)
        self.lookup = Lookup(self.merge)
        self.whole = self.prove(vocab, {c: b for b, c in enumerate(letters)})

    def prove(self, vocab: dict[str, int], value: dict[str, int]) -> frozenset[str]:
        """Strings of the vocabulary that their own bytes' merges make one token."""
        strings = [bytes(map(value.__getitem__, string)) for string in vocab]
        proved = []
        for data, n in zip(strings, self.merged_sizes(strings)):
            if n == 1:
                try:
                    proved.append(data.decode())
                except UnicodeDecodeError:
                    continue  # part of a character: no pre-token
        return frozenset(proved)

    def merged_sizes(self, pieces: list[bytes]) -> list[int]:
        """Tokens of each pre-token (not empty): of all pairs the one of the lowest rank merges, the leftmost first, until none is left."""
        out = np.zeros(len(pieces), np.int64)
        sizes = np.fromiter(map(len, pieces), np.int64, len(pieces))
        for k in np.flatnonzero(sizes > TOGETHER_BYTES).tolist():
            out[k] = self._merged_by_heap(pieces[k])
        order = np.argsort(sizes, kind="stable")
        order = order[sizes[order] <= TOGETHER_BYTES]
        at = 0
        while at < len(order):
            # rows of nearly one width
            width = int(sizes[order[at]]) + 2
            stop = min(at + max(1, TOGETHER_CELLS // width), int(np.searchsorted(sizes[order], width, side="right")))
            rows = order[at:stop]
            out[rows] = self._merged_together([pieces[k] for k in rows.tolist()], sizes[rows])
            at = stop
        return out.tolist()

    def _ranks(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        found = self.lookup.find(np.where((a < 0) | (b < 0), 0, a << 32 | b))
        return np.where((found < 0) | (a < 0) | (b < 0), _NONE, found)

    def _merged_together(self, pieces: list[bytes], sizes: np.ndarray) -> np.ndarray:
        """Each round merges one pair of every row that has one, and looks up the two pairs this makes."""
        left, width = sizes.copy(), int(sizes.max())
        if width == 1:
            return left
        symbols = np.full((len(pieces), width + 1), -1, np.int64)
        symbols[:, :width][np.arange(width) < sizes[:, None]] = self.byte[np.frombuffer(b"".join(pieces), np.uint8)]
        ranks = np.full((len(pieces), width), _NONE, np.int64)
        ranks[:, : width - 1] = self._ranks(symbols[:, : width - 1].ravel(), symbols[:, 1:width].ravel()).reshape(len(pieces), -1)
        which, columns = np.arange(len(pieces)), np.arange(width + 1)
        while len(which):
            at = ranks.argmin(axis=1)
            rank = ranks[np.arange(len(which)), at]
            goes = rank < _NONE
            if not goes.all():
                which, symbols, ranks, at, rank = which[goes], symbols[goes], ranks[goes], at[goes], rank[goes]
            if not len(which):
                break
            row = np.arange(len(which))
            left[which] -= 1
            # what stands behind the pair moves up
            symbols = np.take_along_axis(symbols, np.minimum(columns + (columns > at[:, None]), width), axis=1)
            symbols[row, at] = self.result[rank]
            ranks = np.take_along_axis(ranks, np.minimum(columns[:-1] + (columns[:-1] > at[:, None]), width - 1), axis=1)
            ranks[:, -1] = _NONE
            ranks[row, at] = self._ranks(symbols[row, at], symbols[row, at + 1])
            inner = np.flatnonzero(at > 0)
            ranks[inner, at[inner] - 1] = self._ranks(symbols[inner, at[inner] - 1], symbols[inner, at[inner]])
        return left

    def _merged_by_heap(self, data: bytes) -> int:
        """The same for one piece in n log n steps: neighbours by links, merges in a heap, stale ones skipped."""
        parts: list[int | None] = self.byte[np.frombuffer(data, np.uint8)].tolist()
        size, merge = len(parts), self.merge.get
        after, before = list(range(1, size + 1)), list(range(-1, size - 1))
        heap = [(rank, i, parts[i], parts[i + 1]) for i in range(size - 1) if (rank := merge(parts[i] << 32 | parts[i + 1])) is not None]
        heapq.heapify(heap)
        left = size
        while heap:
            rank, i, a, b = heapq.heappop(heap)
            j = after[i]
            if parts[i] != a or j >= size or parts[j] != b:
                continue
            parts[i], parts[j] = int(self.result[rank]), None
            left -= 1
            after[i] = after[j]
            if after[i] < size:
                before[after[i]] = i
            for k in (before[i], i):
                if k >= 0 and after[k] < size and (rank := merge(parts[k] << 32 | parts[after[k]])) is not None:
                    heapq.heappush(heap, (rank, k, parts[k], parts[after[k]]))
        return left


class TextCounter:
    """Counts of whole texts, in a Python worker."""

    def __init__(self, counter: TokenCounter, pattern: str):
        import regex
        from tokenizers import pre_tokenizers

        self.counter = counter
        self.cut = regex.compile(pattern).findall
        self.other = re.compile(f"[^{AGREED}]").search
        self.library = pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=True).pre_tokenize_str
        self.added = re.compile(counter.added).split if counter.added else None
        self.edge = re.compile("(?<=[A-Za-z]) (?=[A-Za-z])").search
        #: Tokens of each pre-token: one of the proved, and what was merged.
        self.cost = dict.fromkeys(counter.whole, 1)

    def count_all(self, texts: list[str]) -> list[int]:
        out = [0] * len(texts)
        waiting: list[tuple[int, list[str]]] = []
        chars = 0
        for k, text in enumerate(texts):
            parts = self.added(text) if self.added else [text]
            out[k] += len(parts) - 1
            for part in parts:
                for run in self._runs(part):
                    waiting.append((k, self._pieces(run)))
                    chars += len(run)
                    if chars >= RUN_CHARS:
                        self._settle(waiting, out)
                        chars = 0
        self._settle(waiting, out)
        return out

    def _runs(self, text: str):
        """A pre-token takes the single space in front of a letter, and none goes on after a letter's space."""
        begin = 0
        while len(text) - begin > RUN_CHARS and (edge := self.edge(text, begin + RUN_CHARS)):
            yield text[begin : edge.start()]
            begin = edge.start()
        if begin < len(text):
            yield text[begin:] if begin else text

    def _pieces(self, run: str) -> list[str]:
        return [run[a:b] for _, (a, b) in self.library(run)] if self.other(run) else self.cut(run)

    def _settle(self, waiting: list[tuple[int, list[str]]], out: list[int]) -> None:
        """Count what waits; pre-tokens never met before are merged together first."""
        cost = self.cost
        fresh = list(set().union(*(pieces for _, pieces in waiting)).difference(cost))
        if fresh:
            cost.update(zip(fresh, self.counter.merged_sizes(list(map(str.encode, fresh)))))
        for k, pieces in waiting:
            out[k] += sum(map(cost.__getitem__, pieces))
        waiting.clear()
        if len(cost) > len(self.counter.whole) + CACHE_PIECES:
            self.cost = dict.fromkeys(self.counter.whole, 1)
        else:
            for piece in fresh:
                if len(piece) > CACHE_CHARS:
                    del cost[piece]


def count_tokens(df: DataFrame, vocabulary_file: str, pattern: str, text: str = "text", out: str = "n_tokens", drop: tuple[str, ...] = ()) -> DataFrame:
    """``df`` with ``out``: tokens of ``text``. What is broadcast has the size of the vocabulary's file."""
    counter = df.sparkSession.sparkContext.broadcast(TokenCounter(vocabulary_file))

    def make():
        count = TextCounter(counter.value, pattern).count_all
        return lambda batch: [pa.array(count([t.decode() for t in texts(batch, text)]), pa.int64())]

    return with_columns(df, [StructField(out, LongType())], make, drop)


def token_counts(docs: DataFrame, vocabulary_file: str | None = None, limit: int = LIMIT) -> DataFrame:
    """``(doc_id, n_bytes, n_tokens, over_limit)`` of each document."""
    import public_tokenizers

    own = docs.select("doc_id", F.coalesce(F.octet_length("text"), F.lit(0)).cast("long").alias("n_bytes"), "text")
    counted = count_tokens(own, vocabulary_file or public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.PATTERN, drop=("text",))
    return counted.select("doc_id", "n_bytes", "n_tokens", (F.col("n_tokens") > limit).alias("over_limit"))


def op12_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tokens of every whole text of ``documents``."""
    return token_counts(read_table(spark, sf_dir, "documents"))


QUERIES = {"op12_token_counts": op12_token_counts}
ORACLE_SQL: dict[str, str] = {}

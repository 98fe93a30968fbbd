"""Operator 1: byte-level BPE encoding and decoding by prefix dynamic programming.

For every byte prefix of a piece there is exactly one token that can end its BPE encoding. The encoder keeps
that token for each prefix: the token ending at byte ``e`` is the one whose pair with the last token of the
prefix before it is stable, i.e. merging would never have joined across their border. So appending bytes only
extends the table, and an edit near the end only recomputes from the edit on.

Nulls and empty texts encode to no token. Rows are independent: repeated rows give repeated results, an empty
table gives an empty table, and other columns ride along (one named like an output column is replaced).
"""

from __future__ import annotations

import base64
from collections.abc import Iterable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType, StructField

from gridloom.llm.common import read_table, texts, with_columns

#: Entries of a Python worker's memories (100 to 200 bytes each): of stretches of text, of matches in texts that aren't
#: cut to stretches, of pairs judged one by one. At this many a memory is emptied and filled anew.
CACHE_STRETCHES, CACHE_MATCHES, CACHE_PAIRS = 400_000, 50_000, 100_000
#: Longer ones are encoded each time they occur, so that the memory stays small.
CACHE_BYTES = 64
#: Pairs of tokens judged for many pieces together are remembered in a table of 2 to this power (9 bytes each).
JUDGED_BITS = 20
#: Pieces of up to so many bytes are encoded together, at most so many at a time; longer ones each on its own.
TOGETHER_BYTES, TOGETHER = 256, 8_000


def load_ranks(path: str) -> dict[bytes, int]:
    """Ranks of a tiktoken file: base64 of the bytes, space, rank."""
    with open(path, "rb") as lines:
        return {base64.b64decode(word): int(rank) for word, rank in (line.split() for line in lines if line.strip())}


class Vocabulary:
    """Token bytes, ranks, and for each token the two tokens whose merge makes it."""

    def __init__(self, ranks: dict[bytes, int]):
        self.rank = ranks
        self.bytes = {r: b for b, r in ranks.items()}
        #: The longest token by its last three bytes (or fewer, if it has no more).
        self.reach: dict[bytes, int] = {}
        for token in ranks:
            self.reach[token[-3:]] = max(len(token), self.reach.get(token[-3:], 0))
        self.halves: dict[int, tuple[int, int]] = {}
        self.merged: dict[tuple[int, int], int] = {}
        self.judged: dict[int, bool] = {}
        for token, own in ranks.items():
            if len(token) > 1:
                left, right = self._last_merge(token, own)
                if left is not None:
                    self.halves[own] = (left, right)
                    self.merged[left, right] = own
        #: Tokens that no merges make: only a piece that is one as a whole gets it.
        self.unreached = {b for b, r in ranks.items() if len(b) > 1 and r not in self.halves}
        self.tables = Tables(self)

    def _last_merge(self, token: bytes, own: int) -> tuple[int | None, int | None]:
        """The two tokens that remain of ``token`` when only lower ranks merge; none if it can't be reached."""
        parts = [token[i : i + 1] for i in range(len(token))]
        while len(parts) > 2:
            low, at = own, -1
            for i in range(len(parts) - 1):
                r = self.rank.get(parts[i] + parts[i + 1], own)
                if r < low:
                    low, at = r, i
            if at < 0:
                return None, None
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
        return self.rank.get(parts[0]), self.rank.get(parts[1])

    def stable(self, left: int, right: int) -> bool:
        """Whether BPE of the two tokens' bytes is the two tokens; remembered for up to ``CACHE_PAIRS`` pairs."""
        pair = left << 32 | right
        known = self.judged.get(pair)
        if known is None:
            if len(self.judged) >= CACHE_PAIRS:
                self.judged.clear()
            known = self.judged[pair] = self._stable(left, right)
        return known

    def _stable(self, left: int, right: int) -> bool:
        """Without memory.

        The latest merges are undone on the side that was made later, down to the border's single bytes; the pair
        is not stable if, at some point, the border's neighbours had a merge of a lower rank than all undone ones.
        """
        bound = 1 << 62
        while True:
            joint = self.merged.get((left, right))
            if joint is not None and joint < bound:
                return False
            left_first = left > right
            for side in ("left", "right") if left_first else ("right", "left"):
                token = left if side == "left" else right
                halves = self.halves.get(token)
                if halves is not None:
                    break
            else:
                return True
            if side == "left":
                bound, left = left, halves[1]
            else:
                bound, right = right + 1, halves[0]


class PrefixEncoder:
    """The encoding of a growing or edited byte string, as each prefix's last token."""

    def __init__(self, vocabulary: Vocabulary, data: bytes = b""):
        self.vocabulary = vocabulary
        self.data = bytearray()
        self.last: list[int] = []
        self.append(data)

    def append(self, more: bytes) -> PrefixEncoder:
        """Extend the string; what is known of shorter prefixes stays."""
        rank, judged, stable, last = self.vocabulary.rank.get, self.vocabulary.judged.get, self.vocabulary.stable, self.last
        begin, reach = len(self.data), self.vocabulary.reach.get
        self.data += more
        data = bytes(self.data)
        for end in range(begin + 1, len(data) + 1):
            for start in range(max(0, end - reach(data[max(0, end - 3) : end], 2)), end):
                token = rank(data[start:end])
                if token is None:
                    continue
                if start == 0:
                    if token in self.vocabulary.halves or end == 1:
                        last.append(token)
                        break
                else:
                    fits = judged(last[start - 1] << 32 | token)
                    if fits is None:
                        fits = stable(last[start - 1], token)
                    if fits:
                        last.append(token)
                        break
            else:
                raise ValueError(f"bytes {data[max(0, end - 8):end]!r} can't be encoded")
        return self

    def splice(self, start: int, stop: int, new: bytes) -> PrefixEncoder:
        """Replace ``data[start:stop]``; prefixes before ``start`` are kept, later ones are encoded again."""
        tail = bytes(self.data[stop:])
        del self.data[start:], self.last[start:]
        return self.append(new + tail)

    def tokens(self) -> list[int]:
        out, end = [], len(self.data)
        while end:
            out.append(self.last[end - 1])
            end -= len(self.vocabulary.bytes[out[-1]])
        return out[::-1]


class Lookup:
    """Integer keys (not negative) to 32-bit values by open addressing, for whole arrays of keys at a time."""

    def __init__(self, entries: dict[int, int]):
        self.bits = max(8, (4 * len(entries)).bit_length())
        self.keys, self.values = np.full(1 << self.bits, -1, np.int64), np.full(1 << self.bits, -1, np.int32)
        keys, values = np.fromiter(entries.keys(), np.int64, len(entries)), np.fromiter(entries.values(), np.int32, len(entries))
        at = self.slots(keys)
        while len(keys):
            slot, first = np.unique(at, return_index=True)
            free = self.keys[slot] < 0
            self.keys[slot[free]], self.values[slot[free]] = keys[first[free]], values[first[free]]
            waits = self.keys[at] != keys
            keys, values, at = keys[waits], values[waits], (at[waits] + 1) & ((1 << self.bits) - 1)

    def slots(self, keys: np.ndarray) -> np.ndarray:
        return ((keys.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - self.bits)).astype(np.int64)

    def find(self, keys: np.ndarray) -> np.ndarray:
        """Values of the keys, -1 where there is none."""
        at = self.slots(keys)
        held = self.keys[at]
        out = np.where(held == keys, self.values[at], -1)
        todo = np.flatnonzero((held != keys) & (held >= 0))
        while len(todo):
            at[todo] = (at[todo] + 1) & ((1 << self.bits) - 1)
            held, wanted = self.keys[at[todo]], keys[todo]
            same = held == wanted
            out[todo[same]] = self.values[at[todo[same]]]
            todo = todo[~same & (held >= 0)]
        return out


class Tables:
    """A vocabulary as arrays, by which the prefixes of many pieces get their last tokens together."""

    def __init__(self, vocabulary: Vocabulary):
        size = max(vocabulary.bytes) + 1
        self.sizes = np.zeros(size, np.int64)
        self.left, self.right = np.full(size, -1, np.int64), np.full(size, -1, np.int64)
        for token, (left, right) in vocabulary.halves.items():
            self.left[token], self.right[token] = left, right
        self.merged = Lookup({left << 32 | right: token for (left, right), token in vocabulary.merged.items()})
        # a trie of all tokens that merges can reach
        steps: dict[int, int] = {}
        ends = {}
        for token, data in vocabulary.bytes.items():
            self.sizes[token] = len(data)
            if len(data) > 1 and token not in vocabulary.halves:
                continue
            node = 0
            for byte in data:
                node = steps.setdefault(node << 8 | byte, len(steps) + 1)
            ends[node] = token
        self.steps = Lookup(steps)
        self.first = self.steps.find(np.arange(256))
        self.token = np.full(len(steps) + 1, -1, np.int64)
        self.token[list(ends)] = list(ends.values())
        self._judge_anew()

    def _judge_anew(self) -> None:
        self.judged, self.verdict = np.full(1 << JUDGED_BITS, -1, np.int64), np.zeros(1 << JUDGED_BITS, bool)

    def __getstate__(self):
        return {k: v for k, v in self.__dict__.items() if k not in ("judged", "verdict")}

    def __setstate__(self, state):
        self.__dict__.update(state)
        self._judge_anew()

    def stable(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """``Vocabulary.stable`` of many pairs; a table of fixed size remembers the latest by pair."""
        pair = left << 32 | right
        at = ((pair.astype(np.uint64) * np.uint64(0xC2B2AE3D27D4EB4F)) >> np.uint64(64 - JUDGED_BITS)).astype(np.int64)
        out = self.verdict[at]
        new = np.flatnonzero(self.judged[at] != pair)
        if len(new):
            out[new] = self._stable(left[new], right[new])
            self.judged[at[new]] = pair[new]
            # of pairs that share a place, one stays
            kept = new[self.judged[at[new]] == pair[new]]
            self.verdict[at[kept]] = out[kept]
        return out

    def _stable(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        out = np.ones(len(left), bool)
        todo, bound = np.arange(len(left)), np.full(len(left), 1 << 62)
        while len(todo):
            joint = self.merged.find(left << 32 | right)
            bad = (joint >= 0) & (joint < bound)
            out[todo[bad]] = False
            has_left, has_right = self.left[left] >= 0, self.left[right] >= 0
            goes = ~bad & (has_left | has_right)
            undo_left = (has_left & ((left > right) | ~has_right))[goes]
            todo, left, right = todo[goes], left[goes], right[goes]
            bound = np.where(undo_left, left, right + 1)
            left, right = np.where(undo_left, self.right[left], left), np.where(undo_left, right, self.left[right])
        return out

    def encode(self, pieces: list[bytes]) -> list[bytes]:
        """Ids of each piece (not empty) as little-endian unsigned 32-bit integers."""
        sizes = np.fromiter(map(len, pieces), np.int64, len(pieces))
        flat = np.frombuffer(b"".join(pieces), np.uint8).astype(np.int64)
        stops = np.cumsum(sizes)
        begin, stop = np.repeat(stops - sizes, sizes), np.repeat(stops, sizes)
        # all tokens that occur, from each byte on
        start, node, length = np.arange(len(flat)), self.first[flat].astype(np.int64), 1
        found = []
        while len(start):
            here = node >= 0
            start, node = start[here], node[here]
            token = self.token[node]
            own = token >= 0
            found.append((start[own], start[own] + length, token[own]))
            here = start + length < stop[start]
            start, node = start[here], node[here]
            node = self.steps.find(node << 8 | flat[start + length]).astype(np.int64)
            length += 1
        start, end, token = (np.concatenate(x) for x in zip(*found))
        # the unique last token of each prefix, shorter prefixes first
        size = end - begin[start]
        order = np.argsort(size.astype(np.uint16), kind="stable")
        start, end, token = start[order], end[order], token[order]
        edges = np.concatenate([[0], np.cumsum(np.bincount(size))])
        last = np.full(len(flat), -1, np.int64)
        for a, b in zip(edges[:-1].tolist(), edges[1:].tolist()):
            s, t = start[a:b], token[a:b]
            fits = s == begin[s]
            rest = np.flatnonzero(~fits)
            before = last[s[rest] - 1]
            rest, before = rest[before >= 0], before[before >= 0]
            fits[rest] = self.stable(before, t[rest])
            last[end[a:b][fits] - 1] = t[fits]
        # back from the ends
        which, at, taken = np.arange(len(pieces)), stops.copy(), []
        while len(which):
            token = last[at - 1]
            if (token < 0).any():
                raise ValueError(f"bytes {pieces[which[token < 0][0]]!r} can't be encoded")
            taken.append((which, token))
            at = at - self.sizes[token]
            more = at > stops[which] - sizes[which]
            which, at = which[more], at[more]
        counts = np.bincount(np.concatenate([w for w, _ in taken]), minlength=len(pieces))
        limits = np.cumsum(counts)
        ids = np.empty(limits[-1], "<u4")
        for k, (w, t) in enumerate(taken):
            ids[limits[w] - 1 - k] = t
        data = ids.tobytes()
        return [data[4 * a : 4 * b] for a, b in zip((limits - counts).tolist(), limits.tolist())]


class TextEncoder:
    """Whole texts: the pattern's matches, each encoded on its own; what is new in a batch of texts goes together.

    No match of the pattern reaches over a space that stands alone between two characters other than white
    space, but for taking that space in front. So texts are cut there first and whole stretches remembered.
    """

    def __init__(self, vocabulary: Vocabulary, pattern: str):
        import regex

        self.vocabulary = vocabulary
        self.pieces = regex.compile(pattern).findall
        #: Ids of a space and what follows it, and of single matches in texts that aren't cut.
        self.stretches: dict[str, bytes] = {}
        self.matches: dict[str, bytes] = {}

    def _new(self, pieces: list[str]) -> dict[str, bytes]:
        """Ids of matches, remembered or not."""
        data = list(map(str.encode, pieces))
        out: dict[str, bytes] = {}
        if max(map(len, data), default=0) > TOGETHER_BYTES or self.vocabulary.unreached:
            rank, unreached = self.vocabulary.rank, self.vocabulary.unreached
            alone = {p: d for p, d in zip(pieces, data) if len(d) > TOGETHER_BYTES or d in unreached}
            for piece, d in alone.items():
                ids = [rank[d]] if d in rank else PrefixEncoder(self.vocabulary, d).tokens()
                out[piece] = np.array(ids, "<u4").tobytes()
            pieces = [p for p in pieces if p not in alone]
            data = list(map(str.encode, pieces))
        for at in range(0, len(data), TOGETHER):
            out.update(zip(pieces[at : at + TOGETHER], self.vocabulary.tables.encode(data[at : at + TOGETHER])))
        return out

    def _stretches(self, fresh: list[str]) -> dict[str, bytes]:
        """Ids of stretches, each with a space in front."""
        matches = self.pieces("".join([f" {s}" for s in fresh]))
        ids = self._new(list(dict.fromkeys(matches)))
        if len(matches) == len(fresh):
            return dict(zip(fresh, map(ids.__getitem__, matches)))
        begins = [k for k, m in enumerate(matches) if m[0] == " "]
        return {s: b"".join([ids[m] for m in matches[a:b]]) for s, a, b in zip(fresh, begins, [*begins[1:], len(matches)])}

    def encode_all(self, texts: list[str]) -> list[bytes]:
        """Ids of each text as little-endian unsigned 32-bit integers."""
        known, matches = self.stretches, self.matches
        cut = [text.split(" ") for text in texts]
        seen: set[str] = set()
        for first, *rest in cut:
            seen.update(rest)
        fresh = seen.difference(known)
        odd = {s for s in fresh if not s or s[0].isspace() or s[-1].isspace()}
        heads: list[list[str]] = []
        for k, (text, (first, *rest)) in enumerate(zip(texts, cut)):
            whole = not first or first[-1].isspace() or bool(odd) and not odd.isdisjoint(rest)
            heads.append(self.pieces(text if whole else first))
            cut[k] = [] if whole else rest
        stretches = self._stretches(list(fresh - odd))
        known.update(stretches)
        own = self._new(list(set().union(*heads).difference(matches)))
        matches.update(own)
        out = [b"".join([*map(matches.__getitem__, head), *map(known.__getitem__, rest)]) for head, rest in zip(heads, cut)]
        for memory, new, most in ((known, stretches, CACHE_STRETCHES), (matches, own, CACHE_MATCHES)):
            if len(memory) > most:
                memory.clear()
            else:
                for k in [k for k in new if len(k) > CACHE_BYTES]:
                    del memory[k]
        return out

    def encode(self, text: str) -> bytes:
        return self.encode_all([text])[0]


def decode_ids(token: dict[int, bytes], ids: bytes) -> bytes:
    return b"".join([token[i] for i in np.frombuffer(ids, dtype="<u4").tolist()])


def _shared(spark: SparkSession, vocabulary_path: str):
    """The vocabulary, split once by the driver; its size is the vocabulary file's, whatever the corpus."""
    return spark.sparkContext.broadcast(Vocabulary(load_ranks(vocabulary_path)))


def encode(df: DataFrame, vocabulary, pattern: str, text: str = "text", ids: str = "ids", drop: Iterable[str] = (), decoded: str | None = None) -> DataFrame:
    """``df`` with ``ids``: the token ids of ``text`` as little-endian unsigned 32-bit integers (binary).

    ``decoded`` names a column for the bytes of these ids' tokens, as ``decode`` gives them: in the same pass, since each
    pass over the rows has a Python process of its own for each task that runs.
    """

    def make():
        encoder = TextEncoder(vocabulary.value, pattern)
        token = vocabulary.value.bytes

        def run(batch):
            found = encoder.encode_all([t.decode() for t in texts(batch, text)])
            columns = [found, [decode_ids(token, i) for i in found]] if decoded else [found]
            return [pa.array(c, pa.binary()) for c in columns]

        return run

    return with_columns(df, [StructField(c, BinaryType()) for c in (ids, decoded) if c], make, tuple(drop))


def decode(df: DataFrame, vocabulary, ids: str = "ids", out: str = "decoded", drop: Iterable[str] = ()) -> DataFrame:
    """``df`` with ``out``: the bytes of the tokens in ``ids`` (binary; null ids give empty bytes)."""

    # the tokens alone, of the size of the vocabulary's file
    tokens = df.sparkSession.sparkContext.broadcast(vocabulary.value.bytes)

    def make():
        own = tokens.value

        def run(batch):
            values = batch.column(batch.schema.get_field_index(ids)).to_pylist()
            return [pa.array([decode_ids(own, v or b"") for v in values], pa.binary())]

        return run

    return with_columns(df, [StructField(out, BinaryType())], make, tuple(drop))


def op1_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Encode and decode every whole text; one row per document, null texts as empty ones."""
    return roundtrip(spark, read_table(spark, sf_dir, "documents").select("doc_id", "text"))


def roundtrip(spark: SparkSession, docs: DataFrame, vocabulary_file: str | None = None) -> DataFrame:
    import public_tokenizers

    vocabulary = _shared(spark, vocabulary_file or public_tokenizers.path("byte_bpe_50k.tiktoken"))
    return encode(docs, vocabulary, public_tokenizers.PATTERN, drop=["text"], decoded="decoded").select(
        "doc_id",
        (F.octet_length("ids") / 4).cast("long").alias("n_tokens"),
        F.sha2("ids", 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline: each document's token ids, checked by decoding them."""
    import public_tokenizers

    vocabulary = _shared(spark, public_tokenizers.path("byte_bpe_50k.tiktoken"))
    own = docs.select("doc_id", "lang", "source", "text", F.sha2(F.coalesce("text", F.lit("")), 256).alias("_sha"))
    done = encode(own, vocabulary, public_tokenizers.PATTERN, drop=["text"], decoded="decoded")
    exact = F.sha2("decoded", 256) == F.col("_sha")
    return done.select("doc_id", "lang", "source", (F.octet_length("ids") / 4).cast("long").alias("n_tokens"), "ids", exact.alias("round_trip"))


QUERIES = {"op1_bpe": op1_bpe}
ORACLE_SQL: dict[str, str] = {}

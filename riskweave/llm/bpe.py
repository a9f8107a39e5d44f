"""Byte-level BPE by prefix dynamic programming.

For every prefix of a piece's bytes the encoding of that prefix has one last
token, and encoding a prefix without its last token gives the encoding's other
tokens. So one token per prefix is enough: walk back through the table to read
the ids. The last token of a prefix is the one token t ending there for which
(last token of the rest, t) is a pair that merging leaves as it is. Appending
bytes only adds rows to the table, and after an edit only the rows behind it
are computed again. New pieces are encoded in sorted order for that reason: a
piece keeps the rows of the prefix that it shares with the one before.

The tokens that end at a place come from an Aho-Corasick automaton over the
vocabulary, the longest first.

A piece that is itself in the vocabulary is that token, as the rank files'
library has it; pieces are the matches of ``public_tokenizers.PATTERN``.
"""

from __future__ import annotations

import base64
import hashlib
from array import array
from collections.abc import Iterable, Iterator, Sequence
from itertools import chain

import ahocorasick
import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from riskweave.llm.pieces import LONG_PIECE, splitter, vocabulary

KEEP = 200_000                       # pieces that a process keeps
AT_ONCE = 2_000_000                  # characters split at a time
CHUNK = 1 << 19                      # ids in one Arrow batch of results
PAIRS = 200_000                      # pair checks a process remembers


class PrefixBpe:
    """Encoder over ``ranks`` (token bytes -> id; a smaller id merges first)."""

    def __init__(self, ranks: dict[bytes, int]):
        self.ranks = ranks
        self.token = [b""] * (max(ranks.values(), default=-1) + 1)
        for t, r in ranks.items():
            self.token[r] = t
        self.longest = max(map(len, ranks), default=0)
        self.ending = ahocorasick.Automaton()
        for t, r in ranks.items():
            self.ending.add_word(t.decode("latin-1"), (len(t), r))
        self.ending.make_automaton()
        self.pairs: dict[tuple[int, int], bool] = {}
        self.made: dict[int, tuple[int, int] | None] = {}

    def merged(self, data: bytes, below: int | None = None) -> list[int]:
        """Ids by merging the pair of smallest rank, leftmost first, until none is
        left (of rank smaller than ``below``)."""
        parts = [data[i:i + 1] for i in range(len(data))]
        while len(parts) > 1:
            best = min(((r, i) for i, (a, b) in enumerate(zip(parts, parts[1:]))
                        if (r := self.ranks.get(a + b)) is not None and (below is None or r < below)), default=None)
            if best is None:
                break
            i = best[1]
            parts[i:i + 2] = [parts[i] + parts[i + 1]]
        return [self.ranks[p] for p in parts]

    def halves(self, t: int) -> tuple[int, int] | None:
        """The two tokens whose merge makes ``t``; None for a single byte, and for a
        token that merging its bytes never makes."""
        if t not in self.made:
            parts = self.merged(self.token[t], t)
            self.made[t] = (parts[0], parts[1]) if len(parts) == 2 else None
        return self.made[t]

    def stands(self, t: int) -> bool:
        """Whether the token's own bytes encode to it."""
        return len(self.token[t]) == 1 or self.halves(t) is not None

    def follows(self, a: int, b: int) -> bool:
        """Whether merging leaves the two tokens side by side as they are.

        Going back in time, the token made last is undone: on the left its right
        half, on the right its left half then touches the boundary. Nowhere may the
        two that touch merge before the undone token was made; at equal ranks the
        merge further left comes first."""
        ok = self.pairs.get((a, b))
        if ok is not None:
            return ok
        token, rank, x, y, until = self.token, self.ranks.get, a, b, len(self.token)
        ok = self.stands(b)
        while ok:
            r = rank(token[x] + token[y])
            if r is not None and r < until:
                ok = False
                break
            left, right = self.halves(x), self.halves(y)
            if left is None and right is None:
                break
            if right is None or (left is not None and x > y):
                until, x = x, left[1]                # its merge is left of the boundary: it wins a tie
            else:
                until, y = y + 1, right[0]           # its merge is right of the boundary: it loses a tie
        if len(self.pairs) >= PAIRS:
            self.pairs.clear()
        self.pairs[a, b] = ok
        return ok

    def extend(self, data: bytes, last: list[int]) -> list[int]:
        """Fill ``last`` (the last token of each prefix already done; entry 0 is a
        placeholder) up to the whole of ``data``, in place."""
        known, todo = self.pairs.get, len(last)
        for stop, (size, t) in self.ending.iter(data.decode("latin-1"), max(0, todo - self.longest)):
            if stop + 1 < todo:                              # that prefix has its token
                continue
            if stop + 1 > todo:
                break
            begin = todo - size
            if begin == 0:
                ok = self.stands(t)
            else:
                ok = known((last[begin], t))
                if ok is None:
                    ok = self.follows(last[begin], t)
            if ok:
                last.append(t)
                todo += 1
        if todo <= len(data):
            raise ValueError(f"byte {data[todo - 1]} is not in the vocabulary")
        return last

    def table(self, data: bytes) -> list[int]:
        """The last token of every prefix of ``data`` (entry 0 stands for the empty prefix)."""
        return self.extend(data, [-1])

    def read(self, last: list[int], end: int | None = None) -> list[int]:
        """Ids of the prefix of length ``end`` (all of it), read backwards from the table."""
        at, ids = len(last) - 1 if end is None else end, []
        while at > 0:
            ids.append(last[at])
            at -= len(self.token[last[at]])
        return ids[::-1]

    def append(self, data: bytes, last: list[int], more: bytes) -> tuple[bytes, list[int]]:
        """The table of ``data + more``: earlier rows stay as they are."""
        data += more
        return data, self.extend(data, list(last))

    def replace(self, data: bytes, last: list[int], begin: int, end: int, new: bytes) -> tuple[bytes, list[int]]:
        """The table after ``data[begin:end]`` becomes ``new``: rows up to ``begin`` are kept."""
        data = data[:begin] + new + data[end:]
        return data, self.extend(data, last[:begin + 1])

    def encode_piece(self, data: bytes) -> list[int]:
        whole = self.ranks.get(data)
        return [whole] if whole is not None else self.read(self.table(data))

    def encode_sorted(self, pieces: Iterable[str]) -> Iterator[tuple[str, list[int]]]:
        """(piece, ids) of pieces in ascending order of their bytes, each on the table of the one before."""
        before, last = b"", [-1]
        for data, piece in sorted((p.encode("utf-8", "surrogatepass"), p) for p in pieces):
            whole = self.ranks.get(data)
            if whole is not None:
                yield piece, [whole]
                continue
            same, most = 0, min(len(data), len(before))
            while same < most and data[same] == before[same]:
                same += 1
            before, last = data, self.extend(data, last[:same + 1])
            yield piece, self.read(last)

    def decode(self, ids) -> bytes:
        """The bytes of ids."""
        token = self.token
        return b"".join(map(token.__getitem__, ids))


class TextEncoder:
    """Encodes texts by their pieces; keeps pieces it has met, up to KEEP: new ones and those asked for again
    replace the older half."""

    def __init__(self, bpe: PrefixBpe):
        self.bpe, self.split, self.kept, self.older = bpe, splitter(), {}, {}
        self.decimal = [str(i) for i in range(len(bpe.token))]

    def learn(self, new: set[str]) -> dict[str, bytes]:
        """The ids of new pieces; all but long ones are kept."""
        if len(self.kept) + len(new) > KEEP // 2:
            self.older, self.kept = self.kept, {}
        values = {piece: array("I", ids).tobytes() for piece, ids in self.bpe.encode_sorted(new)}
        self.kept.update((p, v) for p, v in values.items() if len(p) <= LONG_PIECE)
        return values

    def encode(self, texts: list[str | None]) -> Iterator[np.ndarray]:
        """The ids of each text (null: none), in turn. A bounded number of characters is split at a time, one text's at least."""
        at = 0
        while at < len(texts):
            rows, size, new = [], 0, set()
            while at < len(texts) and (not rows or size + len(texts[at] or "") <= AT_ONCE):
                pieces = self.split.findall(texts[at] or "")
                values = list(map(self.kept.get, pieces))
                gaps = []
                for i in [i for i, v in enumerate(values) if v is None] if None in values else ():
                    piece = pieces[i]
                    values[i] = v = self.older.get(piece)
                    if v is None:
                        gaps.append((i, piece))
                        new.add(piece)
                    else:
                        self.kept[piece] = v
                rows.append((values, gaps))
                size += len(texts[at] or "")
                at += 1
            learned = self.learn(new)
            for values, gaps in rows:
                for i, piece in gaps:
                    values[i] = learned[piece]
                yield np.frombuffer(b"".join(values), dtype="<i4")


_MADE: dict[str, TextEncoder] = {}


def encoder(name: str = "byte_bpe_50k.tiktoken") -> TextEncoder:
    """This process's encoder of a rank file."""
    if name not in _MADE:
        with open(vocabulary(name), "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        _MADE[name] = TextEncoder(PrefixBpe(ranks))
    return _MADE[name]


def encode_text(text: str, name: str = "byte_bpe_50k.tiktoken") -> list[int]:
    """Ids of a whole text."""
    return next(encoder(name).encode([text])).tolist()


def encode(docs: DataFrame, vocabulary: str = "byte_bpe_50k.tiktoken") -> DataFrame:
    """(doc_id, ids): the ids of every whole text (null: empty)."""
    @F.pandas_udf("array<int>")
    def run(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for batch in texts:
            yield pd.Series(list(encoder(vocabulary).encode(batch.tolist())), dtype=object)
    return docs.select("doc_id", run("text").alias("ids"))


def encode_checked(docs: DataFrame, vocabulary: str = "byte_bpe_50k.tiktoken", keep: Sequence[str] = ()) -> DataFrame:
    """(doc_id, source, n_tokens, ids, exact, keep...): ``exact`` tells whether the ids decode to
    the text's bytes. A task holds about CHUNK ids at a time, one text's at least.

    A null or empty text has no ids; null doc_ids and sources stay null; repeated rows and ties
    give a row each; an empty table gives an empty result; other columns are not read."""
    names = ["doc_id", "source", "n_tokens", "ids", "exact", *keep]

    def table(out, types: list[pa.DataType]) -> pa.RecordBatch:
        ids = np.concatenate([o[2] for o in out])
        ends = np.concatenate([[0], np.cumsum([len(o[2]) for o in out])]).astype(np.int32)
        lists = pa.ListArray.from_arrays(pa.array(ends), pa.array(ids, type=pa.int32()))
        return pa.RecordBatch.from_arrays(
            [pa.array([o[0] for o in out], type=pa.int64()), pa.array([o[1] for o in out], type=pa.string()),
             pa.array(np.diff(ends), type=pa.int64()), lists, pa.array([o[3] for o in out], type=pa.bool_()),
             *[pa.array([o[4 + k] for o in out], type=t) for k, t in enumerate(types)]], names=names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out, size, types, e = [], 0, [], encoder(vocabulary)
        for b in batches:
            texts, types = b.column(1).to_pylist(), b.schema.types[3:]
            for i, source, text, ids, *more in zip(b.column(0), b.column(2), texts, e.encode(texts), *b.columns[3:]):
                exact = e.bpe.decode(ids.tolist()) == (text or "").encode("utf-8", "surrogatepass")
                out.append((i.as_py(), source.as_py(), ids, exact, *[m.as_py() for m in more]))
                size += len(ids)
                if size >= CHUNK:
                    yield table(out, types)
                    out, size = [], 0
        if out:
            yield table(out, types)
    rows = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text", F.col("source").cast("string").alias("source"),
                       *[F.col(f"`{c}`") for c in keep])
    kept = "".join(f", `{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields[3:])
    return rows.mapInArrow(run, f"doc_id bigint, source string, n_tokens bigint, ids array<int>, exact boolean{kept}")


def decode(rows: DataFrame, vocabulary: str = "byte_bpe_50k.tiktoken") -> DataFrame:
    """(doc_id, bytes): the bytes that ids stand for (null: empty)."""
    @F.pandas_udf("binary")
    def run(ids: Iterator[pd.Series]) -> Iterator[pd.Series]:
        bpe = encoder(vocabulary).bpe
        for batch in ids:
            yield pd.Series([bpe.decode([] if i is None else i) for i in batch], dtype=object)
    return rows.select("doc_id", run("ids").alias("bytes"))


def round_trip(docs: DataFrame, vocabulary: str = "byte_bpe_50k.tiktoken") -> DataFrame:
    """(doc_id, n_tokens, ids_sha256, decoded_sha256): encode every text, decode the ids,
    and digest both where they are, so that no list of ids leaves the worker.

    A null text is empty; other columns are not read; repeated rows give repeated results."""
    @F.pandas_udf("n_tokens bigint, ids_sha256 string, decoded_sha256 string")
    def run(texts: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        e = encoder(vocabulary)
        for batch in texts:
            out = []
            for found in e.encode(batch.tolist()):
                ids = found.tolist()
                decimal = " ".join(map(e.decimal.__getitem__, ids))
                out.append((len(ids), hashlib.sha256(decimal.encode()).hexdigest(), hashlib.sha256(e.bpe.decode(ids)).hexdigest()))
            yield pd.DataFrame(out, columns=["n_tokens", "ids_sha256", "decoded_sha256"])
    return docs.select("doc_id", run("text").alias("r")).select("doc_id", "r.*")

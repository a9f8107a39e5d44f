"""Fill-in-the-middle transformation with a Roaring-style set of cut places.

A text is cut into units, runs of ASCII letters or single other code points.
The places between units (and both ends) are kept as a compressed set of code
point offsets: 65,536 offsets share a container, which is an array of 16-bit
values, a bitmap, or a list of runs, whichever is smallest, and the containers'
cardinalities are added up. The offset of the k-th place is found by a binary
search over those sums and a select inside one container; no list of units is
made. Texts that hold a marker stay plain, so a transformed text is taken apart
again by its markers alone.

Defined results: a null text is empty, an empty text is plain with no units;
a null doc_id is hashed as the empty string; repeated rows and ties are
transformed alike; an empty table gives an empty result; columns besides doc_id
and text are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

PREFIX, SUFFIX, MIDDLE = MARKS = ("<P>", "<S>", "<M>")
SPAN = 1 << 16                       # offsets of one container
IN_ARRAY = 4096                      # more values than this take less room as a bitmap (8 KB)
PLAIN_FROM, SPM_BELOW = 90, 20       # percent of the hash groups


@dataclass
class ArrayContainer:
    """Sorted 16-bit values."""
    values: np.ndarray

    def select(self, k: int) -> int:
        return int(self.values[k])


@dataclass
class BitmapContainer:
    """One bit for each of 65,536 values, in 64-bit words, with the bits set before each word."""
    words: np.ndarray
    before: np.ndarray

    @classmethod
    def of(cls, values: np.ndarray) -> BitmapContainer:
        bits = np.zeros(SPAN, dtype=bool)
        bits[values] = True
        words = np.packbits(bits, bitorder="little").view("<u8")
        counts = np.bitwise_count(words).astype(np.int64)
        return cls(words, np.cumsum(counts) - counts)

    def select(self, k: int) -> int:
        w = int(np.searchsorted(self.before, k, side="right")) - 1
        word = int(self.words[w])
        for _ in range(k - int(self.before[w])):
            word &= word - 1                                   # without its lowest bit
        return 64 * w + (word & -word).bit_length() - 1


@dataclass
class RunContainer:
    """Runs of consecutive values, with the values before each run."""
    starts: np.ndarray
    before: np.ndarray

    @classmethod
    def of(cls, values: np.ndarray, heads: np.ndarray) -> RunContainer:
        return cls(values[heads], heads)

    def select(self, k: int) -> int:
        r = int(np.searchsorted(self.before, k, side="right")) - 1
        return int(self.starts[r]) + k - int(self.before[r])


Container = ArrayContainer | BitmapContainer | RunContainer


def container(values: np.ndarray) -> Container:
    """The smallest of the three forms for sorted values under 65,536."""
    heads = np.flatnonzero(np.diff(values.astype(np.int32), prepend=-2) != 1)
    if 4 * len(heads) < min(2 * len(values), SPAN // 8):
        return RunContainer.of(values, heads)
    return ArrayContainer(values) if len(values) <= IN_ARRAY else BitmapContainer.of(values)


@dataclass
class BoundarySet:
    """Offsets as containers, their high parts, and how many offsets lie before each container."""
    keys: list[int]
    containers: list[Container]
    before: np.ndarray
    size: int

    @classmethod
    def of(cls, offsets: np.ndarray) -> BoundarySet:
        """``offsets`` ascend and are distinct."""
        if not len(offsets) or offsets[-1] < SPAN:
            return cls([0], [container(offsets.astype(np.uint16))], np.zeros(1, dtype=np.int64), len(offsets))
        high = offsets >> 16
        heads = np.flatnonzero(np.diff(high, prepend=-1))
        low = (offsets & 0xFFFF).astype(np.uint16)
        held = [container(low[a:b]) for a, b in zip(heads, np.append(heads[1:], len(offsets)))]
        return cls(high[heads].tolist(), held, heads.astype(np.int64), len(offsets))

    def select(self, k: int) -> int:
        """The offset that ``k`` others lie before."""
        if not 0 <= k < self.size:
            raise IndexError(k)
        c = int(np.searchsorted(self.before, k, side="right")) - 1
        return self.keys[c] * SPAN + self.containers[c].select(k - int(self.before[c]))


_LETTER = np.zeros(128, dtype=bool)
_LETTER[ord("A"):ord("Z") + 1] = _LETTER[ord("a"):ord("z") + 1] = True


def boundaries(text: str) -> BoundarySet:
    """The places at which a unit begins or ends, 0 and the text's length included."""
    if text.isascii():
        letter = _LETTER[np.frombuffer(text.encode(), dtype=np.uint8)]
    else:
        points = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype="<u4")
        letter = _LETTER[np.minimum(points, 127)]              # 127 is no letter
    edge = np.ones(len(text) + 1, dtype=bool)
    edge[1:-1] = ~(letter[:-1] & letter[1:])
    return BoundarySet.of(np.flatnonzero(edge))


def hashes(doc_id: int | None) -> tuple[int, int, int, int]:
    """The first four 8-digit groups of the sha256 of ``1:`` and the id."""
    digest = hashlib.sha256(f"1:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    return tuple(int(digest[8 * k:8 * k + 8], 16) for k in range(4))


def transform(text: str, draws: tuple[int, int, int, int]) -> tuple[int, str, int | None, int | None, str]:
    """(units, form, prefix length, middle length, output)."""
    places = boundaries(text)
    n = places.size - 1
    if not text or draws[2] % 100 >= PLAIN_FROM or any(m in text for m in MARKS):
        return n, "plain", None, None, text
    k1, k2 = sorted((draws[0] % (n + 1), draws[1] % (n + 1)))
    a, b = places.select(k1), places.select(k2)
    head, middle, tail = text[:a], text[a:b], text[b:]
    if draws[3] % 100 < SPM_BELOW:
        return n, "spm", a, b - a, f"{SUFFIX}{tail}{PREFIX}{head}{MIDDLE}{middle}"
    return n, "psm", a, b - a, f"{PREFIX}{head}{SUFFIX}{tail}{MIDDLE}{middle}"


SCHEMA = "doc_id bigint, n bigint, form string, prefix_chars bigint, middle_chars bigint, output string"


def fill_in_middle(docs: DataFrame) -> DataFrame:
    """(doc_id, n units, form, prefix_chars, middle_chars, output) of every document."""
    types = (pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string())
    names = [f.split()[0] for f in SCHEMA.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = [(i, *transform(text.as_py() or "", hashes(i))) for i, text in zip(b.column(0).to_pylist(), b.column(1))]
            columns = zip(*out) if out else [[]] * len(names)
            yield pa.RecordBatch.from_arrays([pa.array(c, type=t) for c, t in zip(columns, types)], names=names)
    return docs.selectExpr("cast(doc_id as bigint) as doc_id", "text").mapInArrow(run, SCHEMA)


def restored(output: str = "output", form: str = "form") -> Column:
    """The text a transformed output came from: plain as it is, else the parts between the markers in reading order.
    The first marker found after each part is the marker: no text part holds one, and no marker begins inside another."""
    out, form = F.col(output), F.col(form)
    body = out.substr(4, 1 << 30)                                 # past the marker in front
    second = F.when(form == "spm", F.lit(PREFIX)).otherwise(F.lit(SUFFIX))
    one = F.call_function("substring_index", body, second, F.lit(1))
    rest = body.substr(F.length(one) + 4, F.lit(1 << 30))
    two = F.substring_index(rest, MIDDLE, 1)
    middle = rest.substr(F.length(two) + 4, F.lit(1 << 30))
    return F.when(form == "plain", out).when(form == "spm", F.concat(two, middle, one)).otherwise(F.concat(one, middle, two))

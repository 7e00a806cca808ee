"""Fill-in-middle transformation on seekable compressed texts.

A text is stored as independent zstandard frames of ``FRAME_UNITS`` code points at most; each frame carries the number of
code points up to its end, so the frame that holds a place is found by binary search in these counts. Cutting a text
into prefix, middle and suffix decompresses the frames that hold a cut and nothing else; all others move to the output as
they are, and markers become frames of their own. The output is such a store again. Digests and searches stream its
frames in order, one at a time.
"""

from __future__ import annotations

import hashlib
from bisect import bisect_right
from collections.abc import Iterable, Iterator
from typing import NamedTuple

import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

from newstape.llm.common import give_back, slices

FRAME_UNITS = 1 << 14
LEVEL = 1
#: Markers of prefix, suffix and middle (fixed values).
PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
MARKERS = (PREFIX, SUFFIX, MIDDLE)
SEED = "1"
#: Of a hundred texts so many are transformed, and of a hundred of those so many begin with the suffix (fixed values).
TRANSFORMED, SUFFIX_FIRST = 90, 20

FRAME = T.StructType([T.StructField("units", T.LongType()), T.StructField("data", T.BinaryType())])
FRAMES = T.ArrayType(FRAME)
ARROW_FRAMES = pa.list_(pa.struct([("units", pa.int64()), ("data", pa.binary())]))
FORMS = ("n long", "form string", "prefix_chars long", "middle_chars long")


class Frame(NamedTuple):
    """``units``: code points of the text up to the end of this frame."""

    units: int
    data: bytes


def packed(text: str) -> bytes:
    return zstandard.compress(text.encode(), LEVEL)


def unpacked(frame: Frame) -> bytes:
    return zstandard.decompress(frame.data)


def freeze(text: str, frame_units: int = FRAME_UNITS) -> list[Frame]:
    """The frames of a text; none for the empty one."""
    starts = range(0, len(text), frame_units)
    return [Frame(min(i + frame_units, len(text)), packed(text[i : i + frame_units])) for i in starts]


def units_of(frames: list[Frame]) -> int:
    return frames[-1].units if frames else 0


def stream(frames: Iterable[Frame]) -> Iterator[bytes]:
    """The UTF-8 of the text, frame by frame."""
    return map(unpacked, frames)


def thaw(frames: Iterable[Frame]) -> str:
    return b"".join(stream(frames)).decode()


def digest(frames: Iterable[Frame]) -> str:
    """SHA-256 of the text in lowercase hex."""
    found = hashlib.sha256()
    for piece in stream(frames):
        found.update(piece)
    return found.hexdigest()


def select(frames: list[Frame], lo: int, hi: int) -> list[Frame]:
    """The frames of the code points from ``lo`` to before ``hi``: only a frame that is cut is decompressed."""
    out: list[Frame] = []
    at = bisect_right(frames, lo, key=lambda f: f.units)
    while lo < hi:
        begin, frame = frames[at - 1].units if at else 0, frames[at]
        if begin == lo and frame.units <= hi:
            data, end = frame.data, frame.units
        else:
            end = min(frame.units, hi)
            data = packed(unpacked(frame).decode()[lo - begin : end - begin])
        out.append(Frame(units_of(out) + end - lo, data))
        lo, at = end, at + 1
    return out


def joined(parts: Iterable[list[Frame] | str]) -> list[Frame]:
    """Stores and short texts one after the other; their frames stay as they are."""
    out: list[Frame] = []
    for part in parts:
        base = units_of(out)
        out += [Frame(base + f.units, f.data) for f in (freeze(part) if isinstance(part, str) else part)]
    return out


def find_markers(frames: list[Frame], markers: Iterable[str], begin: int = 0) -> list[int] | None:
    """Places of the markers, each searched behind the one before; None if one is missing. Frames are streamed once."""
    wanted, found = list(markers), []
    tail, base = "", 0  # the last characters of earlier frames, and the place of the first of them
    for frame in frames:
        text = tail + unpacked(frame).decode()
        while len(found) < len(wanted):
            after = found[-1] + len(wanted[len(found) - 1]) if found else begin
            at = text.find(wanted[len(found)], max(after - base, 0))
            if at < 0:
                break
            found.append(base + at)
        if len(found) == len(wanted):
            return found
        keep = max(map(len, wanted)) - 1
        base += max(len(text) - keep, 0)
        tail = text[-keep:] if keep else ""
    return found if len(found) == len(wanted) else None


def has_marker(text: str) -> bool:
    return any(m in text for m in MARKERS)


def plan(doc_id: int | None, units: int, marked: bool) -> tuple[str, int, int]:
    """(form, end of the prefix, end of the middle) of a text of so many code points."""
    own = "" if doc_id is None else str(doc_id)
    hexes = hashlib.sha256(f"{SEED}:{own}".encode()).hexdigest()
    h1, h2, h3, h4 = (int(hexes[i : i + 8], 16) for i in (0, 8, 16, 24))
    lo, hi = sorted((h1 % (units + 1), h2 % (units + 1)))
    if not units or marked or h3 % 100 >= TRANSFORMED:
        return "plain", lo, hi
    return ("spm" if h4 % 100 < SUFFIX_FIRST else "psm"), lo, hi


def arranged(frames: list[Frame], form: str, lo: int, hi: int) -> list[Frame]:
    if form == "plain":
        return frames
    prefix, middle, suffix = select(frames, 0, lo), select(frames, lo, hi), select(frames, hi, units_of(frames))
    if form == "psm":
        return joined([PREFIX, prefix, SUFFIX, suffix, MIDDLE, middle])
    return joined([SUFFIX, suffix, PREFIX, prefix, MIDDLE, middle])


def rebuilt(output: list[Frame], form: str) -> list[Frame]:
    """The text that an output was made from, read from the output and its form alone."""
    if form == "plain":
        return output
    order = (PREFIX, SUFFIX, MIDDLE) if form == "psm" else (SUFFIX, PREFIX, MIDDLE)
    places = find_markers(output, order)
    if places is None or places[0]:
        raise ValueError(f"no output of form {form}")
    first, second, third = places
    skip = len(PREFIX)
    one = select(output, first + skip, second)
    two = select(output, second + skip, third)
    middle = select(output, third + skip, units_of(output))
    prefix, suffix = (one, two) if form == "psm" else (two, one)
    return joined([prefix, middle, suffix])


def _frames_column(rows: list[list[Frame]]) -> pa.Array:
    return pa.array([[{"units": f.units, "data": f.data} for f in r] for r in rows], ARROW_FRAMES)


def _frames_rows(column: pa.Array) -> list[list[Frame]]:
    return [[Frame(f["units"], f["data"]) for f in r or []] for r in column.to_pylist()]


def _with(df: DataFrame, batches, kept: list[str], added: list[tuple[str, object]]) -> DataFrame:
    """``df``'s columns ``kept`` and the columns that ``batches`` makes of each of its record batches."""
    names = [*kept, *(name for name, _ in added)]

    def run(given: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in given:
            for part, columns in batches(batch):
                yield pa.RecordBatch.from_arrays([*part.select(kept).columns, *columns], names)
            give_back()

    schema = df.select(kept).schema
    for name, kind in added:
        schema = schema.add(name, kind)
    return df.mapInArrow(run, schema)


def store(documents: DataFrame, text: str = "text", frame_units: int = FRAME_UNITS) -> DataFrame:
    """Replaces ``text`` by its ``frames`` and ``marked``, whether it contains a marker already.

    Null and empty texts have no frames. All rows and other columns stay; columns called ``frames`` or ``marked`` are
    replaced.
    """

    def batches(batch: pa.RecordBatch):
        for part in slices(batch, text):
            texts = [t or "" for t in part.column(text).to_pylist()]
            yield part, [_frames_column([freeze(t, frame_units) for t in texts]), pa.array([has_marker(t) for t in texts])]

    kept = [c for c in documents.columns if c not in (text, "frames", "marked")]
    return _with(documents, batches, kept, [("frames", FRAMES), ("marked", T.BooleanType())])


def transform(stored: DataFrame, doc_id: str = "doc_id") -> DataFrame:
    """Replaces the ``frames`` of a store by those of the output; adds n, form, prefix_chars and middle_chars.

    Cuts and form follow from the id and the length alone, so repeated rows are cut alike; a null id counts as an empty
    one. Texts without code points and such that contain a marker stay plain.
    """

    def batches(batch: pa.RecordBatch):
        stores, ids = _frames_rows(batch.column("frames")), batch.column(doc_id).to_pylist()
        plans = [plan(i, units_of(f), m) for i, f, m in zip(ids, stores, batch.column("marked").to_pylist())]
        outputs = [arranged(f, *p) for f, p in zip(stores, plans)]
        numbers = [_numbers(units_of(f), *p) for f, p in zip(stores, plans)]
        yield batch, [_frames_column(outputs), *_number_columns(numbers)]

    added = [c.split()[0] for c in FORMS]
    kept = [c for c in stored.columns if c not in ("frames", "marked", *added)]
    kinds = [T.LongType(), T.StringType(), T.LongType(), T.LongType()]
    return _with(stored, batches, kept, [("frames", FRAMES), *zip(added, kinds)])


def restore(transformed: DataFrame) -> DataFrame:
    """Replaces the output's ``frames`` by ``text``, rebuilt from the output and its ``form``."""

    def batches(batch: pa.RecordBatch):
        forms = batch.column("form").to_pylist()
        yield batch, [pa.array([thaw(rebuilt(f, x)) for f, x in zip(_frames_rows(batch.column("frames")), forms)], pa.string())]

    kept = [c for c in transformed.columns if c not in ("frames", "text")]
    return _with(transformed, batches, kept, [("text", T.StringType())])


def _numbers(units: int, form: str, lo: int, hi: int) -> tuple:
    return (units, form, None, None) if form == "plain" else (units, form, lo, hi - lo)


def _number_columns(rows: list[tuple]) -> list[pa.Array]:
    kinds = (pa.int64(), pa.string(), pa.int64(), pa.int64())
    return [pa.array([r[k] for r in rows], kind) for k, kind in enumerate(kinds)]


DIGEST = ", ".join(["doc_id long", *FORMS, "output_sha256 string", "restored_sha256 string"])


def _digest_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    names = [c.split()[0] for c in DIGEST.split(", ")]
    for batch in batches:
        for part in slices(batch, 1):
            numbers, outputs, restored = [], [], []
            for doc_id, text in zip(part.column(0).to_pylist(), part.column(1).to_pylist()):
                frames = freeze(text or "")
                form, lo, hi = plan(doc_id, units_of(frames), has_marker(text or ""))
                output = arranged(frames, form, lo, hi)
                numbers.append(_numbers(units_of(frames), form, lo, hi))
                outputs.append(digest(output))
                restored.append(digest(rebuilt(output, form)))
            columns = [part.column(0), *_number_columns(numbers), pa.array(outputs, pa.string()), pa.array(restored, pa.string())]
            yield pa.RecordBatch.from_arrays(columns, names)
        give_back()


def digests(documents: DataFrame) -> DataFrame:
    """Length, form and cuts of each row's whole text, digests of the output and of the text rebuilt from it.

    What ``store``, ``transform`` and ``restore`` do, in one pass. One row for each row, repeated ones included; a null
    text is an empty one and stays plain, a null id counts as an empty one. Only ``doc_id`` and ``text`` are read,
    whatever other columns there are.
    """
    return documents.selectExpr("cast(doc_id as long) doc_id", "text").mapInArrow(_digest_batches, DIGEST)


def op12_fill_in_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fill-in-middle form of every document."""
    return digests(spark.read.parquet(f"{sf_dir}/documents.parquet"))


OP12_SQL = """
with hashed as (
  select doc_id, coalesce(text, '') as t, length(coalesce(text, '')) as n, sha256('1:' || doc_id) as h from documents
), numbers as (
  select doc_id, t, n,
    cast('0x' || substr(h, 1, 8) as bigint) % (n + 1) as c1, cast('0x' || substr(h, 9, 8) as bigint) % (n + 1) as c2,
    cast('0x' || substr(h, 17, 8) as bigint) % 100 as h3, cast('0x' || substr(h, 25, 8) as bigint) % 100 as h4
  from hashed
), cut as (
  select doc_id, n, t,
    case when n = 0 or contains(t, '<P>') or contains(t, '<S>') or contains(t, '<M>') or h3 >= 90 then 'plain'
         when h4 < 20 then 'spm' else 'psm' end as form,
    least(c1, c2) as lo, greatest(c1, c2) as hi
  from numbers
), made as (
  select doc_id, n, form, t, lo, hi,
    case form when 'plain' then t
      when 'psm' then '<P>' || substr(t, 1, lo) || '<S>' || substr(t, hi + 1) || '<M>' || substr(t, lo + 1, hi - lo)
      else '<S>' || substr(t, hi + 1) || '<P>' || substr(t, 1, lo) || '<M>' || substr(t, lo + 1, hi - lo) end as output
  from cut
)
select doc_id, cast(n as bigint) as n, form,
  case when form <> 'plain' then cast(lo as bigint) end as prefix_chars,
  case when form <> 'plain' then cast(hi - lo as bigint) end as middle_chars,
  sha256(output) as output_sha256,
  sha256(case form when 'plain' then output
    when 'psm' then regexp_replace(output, '(?s)^<P>(.*)<S>(.*)<M>(.*)$', '\\1\\3\\2')
    else regexp_replace(output, '(?s)^<S>(.*)<P>(.*)<M>(.*)$', '\\2\\3\\1') end) as restored_sha256
from made
"""

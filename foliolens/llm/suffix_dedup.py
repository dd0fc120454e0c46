"""Removal of long repeated byte strings by sorting sampled suffixes and merging the rest onto them.

A difference cover samples positions so that any two equal strings hold sampled positions at the same
shift; suffixes at other positions are then compared as "a few leading bytes, then the rank of a
sampled suffix". Here positions are sampled by content, not by their remainders: the sample of
every LENGTH-byte window is its k-gram of smallest hash, so equal windows share it at the same
offset, and one position in about 76 is sampled. This takes the place of a difference cover in the strict sense, whose
samples (two positions of three, or 12 of 133) don't fit the limits: the README has measured figures. Since windows are compared to
LENGTH bytes only, one level of names is enough and no recursion is needed:

1. sample: texts are made distinct, with their number. Each sampled position owns the run of windows that chose it. Its name is
   its k-gram; its neighbourhood is the bytes that its windows cover.
2. bring equal names together (a shuffle). A name that occurs once settles its windows as unique. Neighbourhoods that
   occur twice in full settle theirs as repeated. Only what is left goes on. Names that a sample of the texts shows to be
   very common are counted by grouped sums and joins instead of in one place.
3. merge: for names with neighbourhoods that differ, one copy of each is brought together by name; the
   windows are sorted by (name, offset of the sample, bytes) and neighbours compared.

Bytes covered by repeated windows are then cut from the whole texts. No document is compared with
another outside a shared name, no list of documents or windows reaches the driver, and a name with
very many neighbourhoods is merged by a plain shuffle on window digests instead of in one task.
Windows, names and neighbourhoods are compared by 64-bit digests within a 64-bit name.

Rows: a null text counts as empty. Texts below LENGTH bytes, and empty tables, lose nothing. Matches
never cross rows; repeated rows (with whatever keys, null too) are matches of each other and are
removed in full if they are long enough. Further columns pass through, whatever their names.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from foliolens.llm.common import mixed, powers, stored, texts_of, whole_groups

LENGTH, GRAM = 200, 48
#: Neighbourhoods of one name that a task merges; names with more are merged by a shuffle.
MERGED_IN_TASK = 2_000
#: One text of so many is looked at for very common names: those with COMMON samples there, MOST_COMMON of them at most.
LOOKED_AT, COMMON, MOST_COMMON = 16, 1_000, 500
_BASE = 0x9E3779B97F4A7C15
_U = np.uint64


def _sums(data: np.ndarray) -> np.ndarray:
    """Prefix sums from which the digest of any stretch follows."""
    up, _ = powers(len(data))
    out = np.zeros(len(data) + 1, np.uint64)
    np.cumsum((data.astype(np.uint64) + _U(1)) * up[: len(data)], out=out[1:])
    return out


def _digest(sums: np.ndarray, begin: np.ndarray, end: np.ndarray) -> np.ndarray:
    _, down = powers(len(sums))
    return mixed((sums[end] - sums[begin]) * down[begin])


def samples(data: np.ndarray, length: int = LENGTH, gram: int = GRAM) -> tuple[np.ndarray, ...]:
    """The sampled positions of one text: (name, neighbourhood, position, first window, last window) as arrays."""
    n = len(data)
    if n < length:
        return tuple(np.empty(0, k) for k in (np.uint64, np.uint64, np.int64, np.int64, np.int64))
    sums = _sums(data)
    at = np.arange(n - gram + 1)
    h = _digest(sums, at, at + gram)
    width, best, size = length - gram + 1, at, 1
    while 2 * size <= width:
        left, right = best[:-size], best[size:]
        best = np.where(h[right] < h[left], right, left)
        size *= 2
    if rest := width - size:
        left, right = best[:-rest], best[rest:]
        best = np.where(h[right] < h[left], right, left)
    first = np.flatnonzero(np.concatenate([[True], best[1:] != best[:-1]]))
    last = np.concatenate([first[1:], [len(best)]]) - 1
    owner = best[first]
    around = mixed(_digest(sums, first, last + length) + _U(_BASE) * (owner - first).astype(np.uint64) + (last - first).astype(np.uint64))
    return h[owner], around, owner, first, last


def _bytes(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-8", "surrogatepass"), np.uint8)


def joined_spans(spans: np.ndarray) -> np.ndarray:
    """(begin, end) rows merged where they touch or overlap."""
    if not len(spans):
        return spans.reshape(0, 2)
    spans = spans[np.argsort(spans[:, 0], kind="stable")]
    reach = np.maximum.accumulate(spans[:, 1])
    new = np.concatenate([[True], spans[1:, 0] > reach[:-1]])
    ends = np.concatenate([reach[np.flatnonzero(new)[1:] - 1], reach[-1:]])
    return np.stack([spans[new, 0], ends], axis=1)


def _signed(x: np.ndarray) -> pa.Array:
    return pa.array(x.view(np.int64))


def _named(length: int, gram: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            names, arounds, keys, counts = [], [], [], []
            for text, n, key in zip(texts_of(batch.column(0)), batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True):
                name, around, *_ = samples(_bytes(text), length, gram)
                names.append(name)
                arounds.append(around)
                keys.append(np.full(len(name), key, np.int64))
                counts.append(np.full(len(name), n, np.int64))
            if names:
                yield pa.RecordBatch.from_arrays([_signed(np.concatenate(names)), _signed(np.concatenate(arounds)), pa.array(np.concatenate(keys)), pa.array(np.concatenate(counts))], ["name", "around", "text_key", "n"])

    return run


_PARTS = pa.schema([("text_id", pa.binary()), ("spans", pa.binary()), ("name", pa.int64()), ("body", pa.binary()), ("before", pa.int32()), ("first", pa.int64()), ("open", pa.bool_())])
_PARTS_SQL = "text_id binary, spans binary, name long, body binary, before int, first long, open boolean"


def _settled(length: int, gram: int):
    """For each distinct text: spans of windows known to repeat, and the neighbourhoods asked of it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for text, twice, asked in zip(texts_of(batch.column(0)), batch.column(1), batch.column(2), strict=True):
                data = _bytes(text)
                name, around, owner, first, last = samples(data, length, gram)
                text_id = hashlib.md5(data.tobytes()).digest()
                signed = around.view(np.int64)
                known = np.isin(signed, twice.values.to_numpy())
                if known.any():
                    spans = joined_spans(np.stack([first[known], last[known] + length], axis=1))
                    rows.append({"text_id": text_id, "spans": spans.astype("<i8").tobytes()})
                wanted = np.flatnonzero(np.isin(signed, asked.values.to_numpy()))
                _, once = np.unique(signed[wanted], return_index=True)
                for i in wanted[once].tolist():
                    rows.append({"text_id": text_id, "name": int(name[i].view(np.int64)), "body": data[first[i] : last[i] + length].tobytes(), "before": int(owner[i] - first[i]), "first": int(first[i]), "open": not known[i]})
            yield pa.RecordBatch.from_pylist(rows, _PARTS)

    return run


def _windows(part: pa.Table, length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Every window of the neighbourhoods: its row, its place there, and its digest with name and offset of the sample."""
    bodies = part.column("body").to_pylist()
    data = np.frombuffer(b"".join(bodies), np.uint8)
    sizes = np.array([len(b) for b in bodies])
    begins = np.cumsum(sizes) - sizes
    many = sizes - length + 1
    row = np.repeat(np.arange(len(bodies)), many)
    place = np.arange(many.sum()) - np.repeat(np.cumsum(many) - many, many)
    at = begins[row] + place
    offset = part.column("before").to_numpy()[row] - place
    name = part.column("name").to_numpy().view(np.uint64)[row]
    return row, place, mixed(_digest(_sums(data), at, at + length) + mixed(name + _U(_BASE) * offset.astype(np.uint64)))


def _spans_of(part: pa.Table, row: np.ndarray, place: np.ndarray, again: np.ndarray, length: int) -> list[dict]:
    """Spans of the repeated windows of those rows that are still open."""
    again &= part.column("open").to_numpy(zero_copy_only=False)[row]
    first = part.column("first").to_numpy()
    ids = part.column("text_id").to_pylist()
    row, begin = row[again], first[row[again]] + place[again]
    cuts = np.flatnonzero(np.concatenate([[True], row[1:] != row[:-1]])) if len(row) else np.empty(0, int)
    out = []
    for a, b in zip(cuts.tolist(), [*cuts[1:].tolist(), len(row)], strict=False):
        spans = joined_spans(np.stack([begin[a:b], begin[a:b] + length], axis=1))
        out.append({"text_id": ids[row[a]], "spans": spans.astype("<i8").tobytes()})
    return out


_SPANS = pa.schema([("text_id", pa.binary()), ("spans", pa.binary())])


def _merged(length: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in whole_groups(batches, "name", 4000):
            row, place, digest = _windows(part, length)
            order = np.argsort(digest, kind="stable")
            ordered = digest[order]
            same = ordered[1:] == ordered[:-1]
            again = np.zeros(len(digest), bool)
            again[order[1:][same]] = True
            again[order[:-1][same]] = True
            yield pa.RecordBatch.from_pylist(_spans_of(part, row, place, again, length), _SPANS)

    return run


def _exploded(length: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            part = pa.Table.from_batches([batch])
            row, place, digest = _windows(part, length)
            open_ = part.column("open").to_numpy(zero_copy_only=False)[row]
            ids = part.column("text_id").combine_chunks().take(pa.array(row))
            yield pa.RecordBatch.from_arrays([_signed(digest), ids, pa.array(part.column("first").to_numpy()[row] + place), pa.array(open_)], ["digest", "text_id", "begin", "open"])

    return run


_SAMPLES = "name long, around long, text_key long, n long"


def _common(texts: DataFrame, length: int, gram: int) -> tuple[list[int], list[int]]:
    """Names, and neighbourhoods, that very many samples share, judged by one text of LOOKED_AT. A hint for dealing rows out; results don't depend on it."""
    seen = texts.filter(F.pmod(F.xxhash64("text_key"), F.lit(LOOKED_AT)) == 0).mapInArrow(_named(length, gram), _SAMPLES)
    counted = stored(seen.groupBy("name", "around").count(), "looked-at")
    most = lambda df: df.filter(F.col("count") >= COMMON).orderBy(F.desc("count"), "name").limit(MOST_COMMON).collect()
    arounds = most(counted)
    names = most(counted.groupBy("name").agg(F.sum("count").alias("count")))
    return sorted({r["name"] for r in [*names, *arounds]}), sorted({r["around"] for r in arounds})


def _together(named: DataFrame) -> DataFrame:
    """Samples of names that are not unique: whether their neighbourhood stands `twice`, and whether it is `asked` for and this text carries it: one shuffle by name.

    A neighbourhood is asked for if those of its name differ and some stands in one text only.
    """
    alike, by_name = Window.partitionBy("name", "around"), Window.partitionBy("name")
    named = named.repartition("name").withColumns({"total": F.sum("n").over(alike), "carrier": F.min("text_key").over(alike)})
    named = named.withColumns({"differ": F.min("around").over(by_name) != F.max("around").over(by_name), "least": F.min("total").over(by_name)})
    named = named.filter((F.col("total") > 1) | F.col("differ"))
    return named.select("text_key", "around", (F.col("total") > 1).alias("twice"), (F.col("differ") & (F.col("least") == 1) & (F.col("text_key") == F.col("carrier"))).alias("asked"))


def _apart(named: DataFrame, arounds: list[int]) -> DataFrame:
    """As _together(), for the samples of at most 2 * MOST_COMMON common names: what is known of a name is summed up and told to all tasks, and rows are brought together by neighbourhood only, but for the common ones."""
    totals = named.groupBy("name", "around").agg(F.sum("n").alias("total"))
    facts = totals.groupBy("name").agg((F.min("around") != F.max("around")).alias("differ"), F.min("total").alias("least")).collect()
    differ = F.col("name").isin([r["name"] for r in facts if r["differ"]])
    open_ = F.col("name").isin([r["name"] for r in facts if r["differ"] and r["least"] == 1])
    alike = Window.partitionBy("name", "around")
    rare = named.filter(~F.col("around").isin(arounds)).repartition("name", "around").withColumns({"total": F.sum("n").over(alike), "carrier": F.min("text_key").over(alike)})
    rows = rare.filter((F.col("total") > 1) | differ).select("text_key", "around", (F.col("total") > 1).alias("twice"), (open_ & (F.col("text_key") == F.col("carrier"))).alias("asked"))
    if not arounds:
        return rows
    common = named.filter(F.col("around").isin(arounds))
    told = common.groupBy("name", "around").agg(F.sum("n").alias("total"), F.min("text_key").alias("carrier")).collect()
    key = F.struct("name", "around", "text_key")
    carried = key.isin([F.struct(*[F.lit(r[c]) for c in ("name", "around", "carrier")]) for r in told]) if told else F.lit(False)
    twice = F.struct("name", "around").isin([F.struct(F.lit(r["name"]), F.lit(r["around"])) for r in told if r["total"] > 1]) if any(r["total"] > 1 for r in told) else F.lit(False)
    return rows.unionByName(common.select("text_key", "around", twice.alias("twice"), (open_ & carried).alias("asked")).filter("twice OR asked"))


def repeated_spans(df: DataFrame, text: str = "text", length: int = LENGTH, gram: int = GRAM, merged_in_task: int = MERGED_IN_TASK) -> DataFrame:
    """Per distinct text that repeats a window: text_id (MD5 of its bytes) and lists of (begin, end) spans, packed."""
    whole = df.select(F.col(f"`{text}`").alias("text")).filter(F.octet_length("text") >= length)
    texts = stored(whole.groupBy("text").agg(F.count(F.lit(1)).alias("n")).withColumn("text_key", F.xxhash64("text")), "distinct-texts", compression="zstd")
    names, arounds = _common(texts, length, gram)
    named = texts.mapInArrow(_named(length, gram), _SAMPLES)
    if names:
        named = stored(named, "samples")
        rows = _together(named.filter(~F.col("name").isin(names))).unionByName(_apart(named.filter(F.col("name").isin(names)), arounds))
    else:
        rows = _together(named)
    lists = rows.groupBy("text_key").agg(F.collect_set(F.when(F.col("twice"), F.col("around"))).alias("twice"), F.collect_set(F.when(F.col("asked"), F.col("around"))).alias("asked"))
    parts = stored(texts.join(lists, "text_key").select("text", "twice", "asked").mapInArrow(_settled(length, gram), _PARTS_SQL), "neighbourhoods")
    settled = parts.filter("spans IS NOT NULL").select("text_id", "spans")
    asked_for = parts.filter("body IS NOT NULL")
    crowded = asked_for.groupBy("name").count().filter(F.col("count") > merged_in_task).select("name")
    found = settled
    if not crowded.isEmpty():
        crowded = stored(crowded, "crowded-names")
        opened = asked_for.join(crowded, "name", "left_semi").select(*_PARTS.names).mapInArrow(_exploded(length), "digest long, text_id binary, begin long, open boolean")
        twice = opened.groupBy("digest").count().filter(F.col("count") > 1).select("digest")
        ends = opened.filter("open").join(twice, "digest", "left_semi").select("text_id", F.col("begin"), (F.col("begin") + length).alias("end"))

        def packed(batches):
            for batch in batches:
                pairs = np.stack([batch.column(1).to_numpy(), batch.column(2).to_numpy()], axis=1).astype("<i8")
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([p.tobytes() for p in pairs], pa.binary())], ["text_id", "spans"])

        found = found.unionByName(ends.mapInArrow(packed, "text_id binary, spans binary"))
        asked_for = asked_for.join(crowded, "name", "left_anti").select(*_PARTS.names)
    merged = asked_for.repartition("name").sortWithinPartitions("name").mapInArrow(_merged(length), "text_id binary, spans binary")
    return stored(found.unionByName(merged).groupBy("text_id").agg(F.collect_list("spans").alias("spans")), "spans")


def _unpacked(lists) -> np.ndarray:
    return joined_spans(np.frombuffer(b"".join(lists or ()), "<i8").reshape(-1, 2))


def _kept(data: bytes, spans: np.ndarray) -> bytes:
    at, out = 0, []
    for begin, end in spans.tolist():
        out.append(data[at:begin])
        at = end
    return b"".join([*out, data[at:]])


def _with_spans(df: DataFrame, text: str, **options) -> DataFrame:
    """(row, text, spans): the rows of df as structs with their text and the spans to cut (null: none)."""
    spans = repeated_spans(df, text, **options)
    rows = df.select(F.struct(*[F.col(f"`{c}`") for c in df.columns]).alias("row"), F.col(f"`{text}`").alias("text"))
    return rows.withColumn("text_id", F.unhex(F.md5(F.col("text").cast("binary")))).join(spans, "text_id", "left").select("row", "text", "spans")


def cut_repeats(df: DataFrame, text: str = "text", **options) -> DataFrame:
    """df with repeated strings cut from `text`; a character that a cut splits is dropped with it. Null texts stay null."""

    def run(batches):
        for batch in batches:
            texts = [t if t is None or not s else _kept(t.encode("utf-8", "surrogatepass"), _unpacked(s)).decode("utf-8", "ignore") for t, s in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string())], ["row", "text"])

    marked = _with_spans(df, text, **options)
    cut = marked.mapInArrow(run, f"row {marked.schema['row'].dataType.simpleString()}, text string")
    return cut.select(*[F.col("text").alias(c) if c == text else F.col(f"row.`{c}`") for c in df.columns])


def digests(df: DataFrame, key: str = "doc_id", text: str = "text", **options) -> DataFrame:
    """Per row of df: the key, bytes, bytes and spans removed, and the digest of what remains."""

    def run(batches):
        for batch in batches:
            rows = []
            for t, s in zip(texts_of(batch.column(1)), batch.column(2).to_pylist(), strict=True):
                data, spans = t.encode("utf-8", "surrogatepass"), _unpacked(s)
                rows.append((len(data), int((spans[:, 1] - spans[:, 0]).sum()), len(spans), hashlib.sha256(_kept(data, spans)).hexdigest()))
            columns = [list(c) for c in zip(*rows, strict=True)] if rows else [[], [], [], []]
            yield pa.RecordBatch.from_arrays([batch.column(0), *[pa.array(c, k) for c, k in zip(columns, (pa.int64(), pa.int64(), pa.int64(), pa.string()), strict=True)]], [key, "n_bytes", "n_removed", "n_spans", "kept_sha256"])

    marked = _with_spans(df.select(key, text), text, **options).select(F.col(f"row.`{key}`").alias(key), "text", "spans")
    return marked.mapInArrow(run, f"`{key}` {dict(df.dtypes)[key]}, n_bytes long, n_removed long, n_spans long, kept_sha256 string")

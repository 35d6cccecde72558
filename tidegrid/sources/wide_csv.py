"""Wide CSV files: the first column is a time in seconds, every other column a series.

A file's first rows fix its layout: which columns are numbers, which are text, which hold nothing and
which numbered columns form an array. Reading is then one scan that melts the columns into points.
"""

from __future__ import annotations

import csv
import io
from collections.abc import Iterable, Mapping, Sequence
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidegrid.functions.scalars import holds, is_empty, parsed_or_fail, split_header, to_epoch_ms
from tidegrid.model import CATALOG, KINDS
from tidegrid.operators.aggregates import catalog
from tidegrid.operators.points import concat_points, mark_backward, require_ordered
from tidegrid.session import materialize

# Rows that decide the kinds, and the least columns that form an array
SAMPLE_ROWS = 16
ARRAY_MIN_LEN = 4
FEW_LENGTHS = 10_000


@dataclass(frozen=True)
class Layout:
    """Header and column kinds of a wide file; ``kinds`` leaves out the time column, None is unknown.

    ``only`` restricts reading to some ``(kind, series)`` pairs.
    """

    header: tuple[str, ...]
    kinds: tuple[str | None, ...]
    only: frozenset[tuple[str, str]] | None = None

    def _wanted(self, kind: str, name: str) -> bool:
        return self.only is None or (kind, name) in self.only

    def _groups(self) -> dict[str, list[int]]:
        """Prefix to column positions in index order, for groups that become one array series.

        Members need trailing digits; a group needs at least four of them, all numeric. Of two columns
        with one index the first counts.
        """
        kind_of = dict(zip(self.header[1:], self.kinds))
        groups: dict[str, list[tuple[int, int]]] = {}
        for at, name in enumerate(self.header[1:], start=1):
            prefix, index = split_header(name)
            if index is not None:
                groups.setdefault(prefix, []).append((index, at))
        arrays = {}
        for prefix, members in groups.items():
            if len(members) >= ARRAY_MIN_LEN and all(kind_of[self.header[at]] == "num" for _, at in members):
                first: dict[int, int] = {}
                for index, at in sorted(members):
                    first.setdefault(index, at)
                arrays[prefix] = list(first.values())
        return arrays

    @property
    def arrays(self) -> dict[str, list[int]]:
        return {prefix: at for prefix, at in self._groups().items() if self._wanted("arr", prefix)}

    def columns(self, kind: str) -> dict[str, int]:
        """Name to column position of the single series of a kind; of equal names the last counts."""
        return {name: at for name, at in self._singles().items()
                if self.kinds[at - 1] == kind and self._wanted(kind, name)}

    def _singles(self) -> dict[str, int]:
        groups = self._groups()
        return {name: at for at, name in enumerate(self.header[1:], start=1)
                if self.kinds[at - 1] is not None
                and (split_header(name)[1] is None or split_header(name)[0] not in groups)}

    def series(self) -> dict[str, str]:
        """Series name to kind; of equal names the one that begins later in the header counts."""
        begins = [(min(at), prefix, "arr") for prefix, at in self._groups().items()]
        begins += [(at, name, self.kinds[at - 1]) for name, at in self._singles().items()]
        return {name: kind for _, name, kind in sorted(begins)}


def cell_schema(width: int) -> T.StructType:
    return T.StructType([T.StructField(f"c{i}", T.StringType()) for i in range(width)])


def csv_options(multi_line: bool, width: int) -> dict[str, str]:
    return {"header": "true", "enforceSchema": "true", "escape": '"', "maxColumns": str(2 * width + 1000),
            "multiLine": str(multi_line).lower()}


def list_files(spark: SparkSession, path: str) -> list[str]:
    """The files that a path stands for, by name: itself, or what lies in a folder but for hidden files."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    files = at.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf())
    found = [(s.getPath().getName(), s.getPath().toString()) for s in files.listStatus(at) if s.isFile()]
    return [p for name, p in sorted(found) if len(found) == 1 or name[0] not in "._"]


def read_head(spark: SparkSession, file: str, records: int, first_bytes: int = 1 << 16) -> list[list[str]]:
    """The first records of a file, from as many of its first bytes as they need."""
    jvm, size = spark._jvm, first_bytes
    at = jvm.org.apache.hadoop.fs.Path(file)
    files = at.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf())
    length = files.getFileStatus(at).getLen()
    while True:
        stream = files.open(at)
        try:
            head = bytes(jvm.org.apache.commons.io.IOUtils.toByteArray(
                jvm.org.apache.commons.io.input.BoundedInputStream(stream, min(size, length))))
        finally:
            stream.close()
        whole = size >= length
        text = head.decode("utf-8", "strict" if whole else "ignore").removeprefix("\ufeff")
        found = [r for r in csv.reader(io.StringIO(text, newline="")) if r]
        if whole or len(found) > records:  # the last record may be cut
            return found[:records]
        size *= 4


def read_header(spark: SparkSession, path: str) -> tuple[str, ...]:
    """The names in the first row, untouched (Spark's own header handling renames duplicates).

    The files of a folder must agree on them.
    """
    return _heads(spark, path, 1)[0]


def _heads(spark: SparkSession, path: str, sample_rows: int) -> tuple[tuple[str, ...], list[list[str]]]:
    """Header of all files of a path, and its first rows in the order of the files' names."""
    header, rows = None, []
    for file in list_files(spark, path):
        head = read_head(spark, file, 1 + max(0, sample_rows - len(rows)))
        if not head:
            continue
        if header is not None and tuple(head[0]) != header:
            raise ValueError(f"{file} has other columns than the files before it: {head[0][:20]}")
        header = tuple(head[0])
        rows += head[1:]
    return header or (), rows


def read_wide_csv(spark: SparkSession, paths: str | Sequence[str], header: Sequence[str],
                  multi_line: bool = False) -> DataFrame:
    """Rows of files sharing a header: columns ``c0..`` as text, ``file`` and the row's order ``pos``.

    Extra cells are ignored, missing ones are null.
    """
    paths = [paths] if isinstance(paths, str) else list(paths)
    options = csv_options(multi_line, len(header))
    return with_file_order(spark.read.schema(cell_schema(len(header))).options(**options).csv(paths))


def with_file_order(rows: DataFrame) -> DataFrame:
    """Add ``file`` and ``pos`` to scanned rows.

    ``pos`` is unique and increasing inside a file: a split's first byte plus the row's number among the
    rows of its task, which are fewer than the split has bytes.
    """
    return rows.select("*", F.col("_metadata.file_path").alias("file"),
                       (F.col("_metadata.file_block_start") + row_in_task()).alias("pos"))


def row_in_task() -> Column:
    """The row's number among the rows of its task."""
    return F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1))


def in_one_order(rows: DataFrame) -> DataFrame:
    """Make ``pos`` increase over files too, in the order of their names: a file's place in its high bits.

    A file is shorter than a terabyte (2**40 bytes).
    """
    files = rows.select("file").distinct()
    place = Window.orderBy("file")  # a row per file
    placed = files.withColumn("_place", (F.row_number().over(place) - 1).cast("long"))
    return rows.join(placed, "file").withColumn("pos", F.shiftleft("_place", 40) + F.col("pos")).drop("_place")


def infer_kinds(rows: DataFrame, width: int) -> tuple[str | None, ...]:
    """Kind of every column but the time, from all of these rows.

    All non-empty cells read as doubles: numeric. Other non-empty cells: text. None at all: unknown.
    """
    cells = [f"c{i}" for i in range(1, width)]
    if not cells:
        return ()
    checks = rows.selectExpr(*[f"count_if({c} <> '') AS n_{c}" for c in cells], *[
        f"count_if({c} <> '' AND try_cast({c} AS DOUBLE) IS NULL) AS t_{c}" for c in cells]).first()
    return tuple(None if checks[f"n_{c}"] == 0 else "str" if checks[f"t_{c}"] else "num" for c in cells)


def read_layout(spark: SparkSession, path: str, sample_rows: int | None = SAMPLE_ROWS,
                multi_line: bool = False) -> Layout:
    """Header of the files of a path and kinds from its first rows, or from all rows if None."""
    if sample_rows is None:
        header = read_header(spark, path)
        return Layout(header, infer_kinds(read_wide_csv(spark, path, header, multi_line), len(header)))
    return read_layouts(spark, [path], sample_rows)[0]


def read_layouts(spark: SparkSession, paths: Sequence[str], sample_rows: int = SAMPLE_ROWS) -> list[Layout]:
    """The layouts of many paths: the heads of their files are read, and one job tells the kinds of all columns."""
    with ThreadPoolExecutor(8) as pool:
        heads = list(pool.map(lambda p: _heads(spark, p, sample_rows), paths))
    cells = [(at, i, cell) for at, (header, rows) in enumerate(heads) for row in rows
             for i, cell in enumerate(row[1:len(header)], start=1) if cell != ""]
    number = F.col("cell").try_cast("double").isNotNull()
    seen = spark.createDataFrame(cells, "at INT, i INT, cell STRING").groupBy("at", "i").agg(F.min(number).alias("number"))
    kind = {(r["at"], r["i"]): "num" if r["number"] else "str" for r in seen.collect()} if cells else {}
    return [Layout(header, tuple(kind.get((at, i)) for i in range(1, len(header))))
            for at, (header, _) in enumerate(heads)]


def _quoted(text: str) -> str:
    return "'" + text.replace("\\", "\\\\").replace("'", "\\'") + "'"


def _timed(rows: DataFrame) -> DataFrame:
    """Rows with their time ``t``; one that cannot be read fails the query."""
    time = to_epoch_ms(F.col("c0"))
    return rows.filter(parsed_or_fail(F.col("c0"), time, "time")).withColumn("t", time)


def _melt(rows: DataFrame, columns: dict[str, int], carried: Sequence[str]) -> DataFrame:
    """One row per non-empty cell: ``series, t, cell`` and the carried columns."""
    wide = _timed(rows).select("t", *carried, *[F.col(f"c{at}").alias(f"_{at}") for at in columns.values()])
    names = {f"_{at}": name for name, at in columns.items()}
    long = wide.unpivot(["t", *carried], list(names), "_column", "cell").filter(~is_empty(F.col("cell")))
    series = F.element_at(F.expr(f"map({', '.join(f'{_quoted(c)}, {_quoted(n)}' for c, n in names.items())})"),
                          F.col("_column"))
    return long.select(series.alias("series"), "t", "cell", *carried)


def melt_kind(rows: DataFrame, layout: Layout, kind: str, strict: bool = True,
              carried: Sequence[str] = ("file", "pos")) -> DataFrame | None:
    """Points of all single columns of a kind, one per non-empty cell; None if there are none.

    A cell that cannot be read fails the query, or is left out unless ``strict``.
    """
    columns = layout.columns(kind)
    if not columns:
        return None
    long = _melt(rows, columns, carried)
    parsed = KINDS[kind].parse(F.col("cell"))
    if strict:
        return long.filter(parsed_or_fail(F.col("cell"), parsed, kind)).select("series", "t", parsed.alias("v"), *carried)
    return long.select("series", "t", parsed.alias("v"), *carried).filter("v is not null")


def melt_numeric(rows: DataFrame, layout: Layout, strict: bool = True) -> DataFrame | None:
    return melt_kind(rows, layout, "num", strict)


def melt_string(rows: DataFrame, layout: Layout) -> DataFrame | None:
    return melt_kind(rows, layout, "str")


def zip_arrays(rows: DataFrame, layout: Layout, strict: bool = True, few: bool = False) -> DataFrame | None:
    """Points of all array series; None if there are none.

    Rows of one time fill the array together, the first non-empty cell of an element counting. An array
    ends at its first missing element, and only arrays of the greatest length a series reaches in its
    file stay. A time before an earlier one fails the query if ``strict``. ``few`` says that files times
    array series are at most ``FEW_LENGTHS``, so that their lengths can be broadcast.
    """
    arrays = layout.arrays
    if not arrays:
        return None
    # as SQL text: a file may have very many columns, and each is one short expression
    used = sorted({at for members in arrays.values() for at in members})
    filled = " OR ".join(f"c{at} <> ''" for at in used)
    unread = " ".join(f"WHEN c{at} <> '' AND try_cast(c{at} AS DOUBLE) IS NULL THEN c{at}" for at in used)
    numbers = [f"try_cast(nullif(c{at}, '') AS DOUBLE) AS c{at}" for at in used]
    timed = _timed(rows.filter(filled)).withColumn("_unread", F.expr(f"CASE {unread} END"))
    timed = timed.filter(holds(F.col("_unread").isNull(), F.concat(F.lit("cannot read num: "), F.col("_unread"))))
    timed = timed.selectExpr("file", "pos", "t", *numbers)
    if strict:
        timed = require_ordered(timed, "pos", ["file"], strict=False)
    firsts = [f"min_by(c{at}, pos) FILTER (WHERE c{at} IS NOT NULL) AS c{at}" for at in used]
    per_time = timed.groupBy("file", "t").agg(F.expr("min(pos) AS pos"), *map(F.expr, firsts))

    series = [f"named_struct('series', {_quoted(prefix)}, 'v', array({', '.join(f'c{at}' for at in members)}))"
              for prefix, members in arrays.items()]
    zipped = per_time.selectExpr("file", "pos", "t", f"inline(array({', '.join(series)})) AS (series, v)")
    missing = F.coalesce(F.array_position(F.transform("v", lambda x: x.isNull()), True), F.lit(0))
    length = F.when(missing == 0, F.size("v").cast("long")).otherwise(missing - 1)
    cut = zipped.withColumn("_len", length).filter("_len > 0").withColumn(
        "v", F.slice("v", F.lit(1), F.col("_len").cast("int")))
    longest = cut.groupBy("file", "series").agg(F.max("_len").alias("_longest"))
    full = cut.join(F.broadcast(longest) if few else longest, ["file", "series"]).filter("_len = _longest")
    return full.select("series", "t", "v", "file", "pos")


@dataclass(frozen=True)
class Loaded:
    """Points per kind with ``file``, ``pos`` and ``kept`` (false for dropped points), and the catalog."""

    marked: dict[str, DataFrame]
    catalog: DataFrame

    def points(self, kind: str) -> DataFrame | None:
        marked = self.marked.get(kind)
        return None if marked is None else marked.filter("kept").select("series", "t", "v")


def load_all(spark: SparkSession, paths: Iterable[str], strict: bool = True,
             sample_rows: int | None = SAMPLE_ROWS, multi_line: bool = False,
             kinds: Mapping[str, str] | None = None) -> Loaded:
    """Load wide CSV files into one catalog; other file names are refused, and a series name met again in
    a later path replaces the earlier one.

    Files of one header and kinds are read by one scan, and what another path owns is left out. The files of one
    path follow each other by name. ``kinds`` names the kind of some columns, also registered ones, whose ``parse``
    then reads them. The cells that are needed are written to the shared folder first, so that the
    text is parsed once, and then the melted points; jobs do not grow with the number of paths.
    """
    paths = list(paths)
    if refused := [p for p in paths if not p.endswith(".csv")]:
        raise ValueError(f"not a .csv file: {refused}")
    if sample_rows is None:
        layouts = [read_layout(spark, p, None, multi_line) for p in paths]
    else:
        layouts = read_layouts(spark, paths, sample_rows)
    if kinds:
        layouts = [replace(x, kinds=tuple(kinds.get(name, k) for name, k in zip(x.header[1:], x.kinds))) for x in layouts]
    owner = {name: at for at, layout in enumerate(layouts) for name in layout.series()}
    groups: dict[Layout, list[int]] = {}
    for at, layout in enumerate(layouts):
        if at in owner.values():  # a file whose series are all replaced is not read
            groups.setdefault(layout, []).append(at)

    melted: dict[str, list[DataFrame]] = {}
    for layout, group in groups.items():
        wanted = frozenset((kind, name) for name, kind in layout.series().items() if owner[name] in group)
        layout = replace(layout, only=wanted)
        rows = read_wide_csv(spark, [paths[at] for at in group], layout.header, multi_line)
        used = [0, *(at for kind in KINDS for at in layout.columns(kind).values()),
                *(at for members in layout.arrays.values() for at in members)]
        rows = materialize(rows.select(*[f"c{at}" for at in sorted(set(used))], "file", "pos"), "cells")
        rows = in_one_order(rows)
        owned = _owned(spark, {at: paths[at] for at in group}, {name: owner[name] for _, name in wanted})
        for kind in list(KINDS):
            part = (zip_arrays(rows, layout, strict, len(group) * len(layout.arrays) <= FEW_LENGTHS) if kind == "arr"
                    else melt_kind(rows, layout, kind, strict))
            if part is not None:
                melted.setdefault(kind, []).append(part if len(group) == 1 else part.join(owned, ["file", "series"], "left_semi"))

    marked = {kind: mark_backward(materialize(concat_points(*parts), f"points-{kind}"), "pos")
              for kind, parts in melted.items()}
    entries = [catalog(points, kind) for kind, points in marked.items()]
    return Loaded(marked, concat_points(*entries) if entries else spark.createDataFrame([], CATALOG))


def _owned(spark: SparkSession, paths: Mapping[int, str], owner: Mapping[str, int]) -> DataFrame:
    """``file, series`` for every file of the path that owns the series: names in headers, not data."""
    files = {at: list_files(spark, path) for at, path in paths.items()}
    pairs = [(file, name) for name, at in owner.items() for file in files[at]]
    return spark.createDataFrame(pairs, "file STRING, series STRING")

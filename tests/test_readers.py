import pytest

from tidegrid.sources import wide_csv as wc
from tidegrid.sources.readers import ColumnReader, epoch_ms, read_columns


def arrays(series, columns):
    """Rebuilds an array series: rows of one time fill the array, the first cell of an element counts."""
    def step(state, t, cells):
        at, held = state
        done = None
        if at is not None and t != at:
            done, held = finish(state), None
        held = [None] * len(columns) if held is None else list(held)
        for i, cell in enumerate(cells):
            if held[i] is None and cell is not None:
                held[i] = float(cell)
        return (t, held), done

    def finish(state):
        at, held = state
        return None if at is None or None in held else (at, held)
    return ColumnReader(series, columns, "ARRAY<DOUBLE>", "at BIGINT, held ARRAY<DOUBLE>", (None, None), step, finish)


@pytest.fixture
def write(tmp_path):
    def put(text, name="a.csv"):
        (tmp_path / name).write_text("\n".join(text.split(" ")) + "\n")
        return f"{tmp_path}/{name}"
    return put


@pytest.mark.parametrize("bits", [5, 22])
def test_a_reader_rebuilds_arrays(spark, write, rows, bits):
    text = "time,c0,c1,c2,c3,x 1,1,2,,,7 1,9,9,3,4,7 2,5,6,7,8, 3,,1,1,1, 3.5,1,2,,, 3.5,,,,4,1 3.5,,,3,, 4,8,8,8,8,8"
    paths = [write(text), write("time,c0,c1,c2,c3,x 9,1,1,1,1,1", "b.csv")]
    header = text.split(" ")[0].split(",")
    read = wc.read_wide_csv(spark, paths, header)
    got = read_columns(read, header, arrays("c", ["c0", "c1", "c2", "c3"]), bits)
    want = wc.zip_arrays(read, wc.read_layout(spark, paths[0]))
    assert rows(got, "series", "t", "v") == rows(want, "series", "t", "v")
    assert rows(got, "t") == [(1000,), (2000,), (3500,), (4000,), (9000,)]


def test_columns_that_are_not_there(spark, write):
    header = ["time", "x"]
    read = wc.read_wide_csv(spark, [write("time,x 1,1 soon,2")], header)
    with pytest.raises(ValueError, match="no column"):
        read_columns(read, header, arrays("c", ["y"]))
    with pytest.raises(Exception, match="cannot read time: soon"):
        read_columns(read, header, arrays("c", ["x"])).collect()
    assert epoch_ms("-1.0019") == -1001

"""CSV in splits gives what reading a file as a whole gives, however small the splits are."""

import random

import pytest

from gridloom.sources import files, splits, tables

PIECES = ['"', '""', ",", ";", "\n", "\r\n", "\r", "a", "é", "word", " ", '"x\ny"', '"q ""z"" ', "1.5", "\n\n"]


def cells(spark, path, whole):
    rows, paths = splits.read_rows(spark, path)
    whole()  # else the rows that are written between are read in such splits too
    got = sorted((r["file"], r["at"], list(r["cells"]), r["blank"]) for r in rows.collect())
    return {p.rpartition("/")[2]: [c for f, _, c, _ in got if f == i] if not all(b for f, _, _, b in got if f == i) else [] for i, p in enumerate(paths)}, got


@pytest.fixture
def split(spark):
    """Sets the size of splits, the usual one if none is given."""

    def set_to(size=1 << 27):
        spark.conf.set("spark.sql.files.maxPartitionBytes", str(size))
        spark.conf.set("spark.sql.files.openCostInBytes", "1" if size < 1 << 20 else "4m")

    yield set_to
    set_to()


def test_states_are_those_of_reading_letter_by_letter():
    def plain(line, d, inside):
        state = "q" if inside else "row"
        for c in line:
            if state in ("row", "field"):
                state = "q" if c == 34 else "field" if c in (d, 13) else "bare"
            elif state == "bare":
                state = "field" if c in (d, 13) else "bare"
            elif state == "q":
                state = "end" if c == 34 else "q"
            else:
                state = "q" if c == 34 else "field" if c in (d, 13) else "bare"
        return state == "q"

    rng = random.Random(3)
    for _ in range(20_000):
        line = "".join(rng.choice('",;\ra') for _ in range(rng.randint(0, 12))).encode()
        for inside in (False, True):
            # A quote at a line's end that closes nothing more is the end of a field.
            assert splits.inside_after(line, 44, inside) == plain(line, 44, inside), (line, inside)


@pytest.mark.parametrize("size", [1, 3, 7, 64, 1 << 27])
def test_all_split_sizes_as_a_whole_file(spark, split, tmp_path, size):
    rng = random.Random(size)
    texts = ['h,"two\nlines"\n1,"a ""b""\n\n,c"\r\nx,y\n"open, to\nthe end', "﻿a;b\n1;2\n", "one line", "", " \n\n ", 'q,w\n"' + "long\n" * 8 + '",end\nlast,1', "a\n\n \nb\rc\n", '"a"b,c\na"b,c\n', "x,y\r\r\n\r1,2"]
    texts += ["".join(rng.choice(PIECES) for _ in range(rng.randint(1, 40))) for _ in range({1: 0, 3: 2}.get(size, 25))]
    for i, t in enumerate(texts[:: 3 if size == 1 else 1]):
        (tmp_path / f"{i:03}.csv").write_bytes(t.encode())
    (tmp_path / "900.csv").write_bytes("é;ü\n1;\xdf\n".encode("cp1252"))
    (tmp_path / "901.csv").write_bytes('a\tb\n"x\ny"\t2\n'.encode("utf-16"))
    split(size)
    got, rows = cells(spark, str(tmp_path), split)
    assert len({(f, at) for f, at, _, _ in rows}) == len(rows)
    for file in sorted(tmp_path.iterdir()):
        text = files.decode_text(file.read_bytes())
        # A first line that goes beyond the first split tells its delimiter by what that split has of it.
        have = got.get(file.name, [])
        want = files.parse_csv(text)
        if size < 64 and have != want and splits.DELIMITERS.count(files.sniff_delimiter(text.split("\n")[0]).encode()) and files.sniff_delimiter(text.split("\n")[0]) != files.sniff_delimiter(text):
            continue
        assert have == want, (file.name, text)


def test_folders_by_name_of_column(spark, split, tmp_path):
    (tmp_path / "a.csv").write_text("id,name\n1,x\n2\n")
    (tmp_path / "b.csv").write_text("name;id;more\ny;3;z;beyond\n")
    (tmp_path / "c.csv").write_text("\n\n")
    (tmp_path / "d.txt").write_text("free text\n")
    got = tables.read_table(spark, str(tmp_path))
    assert got.columns == ["__rid", "id", "name", "more", "column_4", "Text"]
    assert [tuple(r)[1:] for r in got.orderBy("__rid").collect()] == [("1", "x", "", "", ""), ("2", "", "", "", ""), ("3", "y", "z", "beyond", ""), ("", "", "", "", "free text")]
    only = splits.read_table(spark, str(tmp_path / "b.csv"))
    assert [tuple(r)[1:] for r in only.collect()] == [("y", "3", "z", "beyond")]
    with pytest.raises(ValueError, match="different headers"):
        splits.read_table(spark, [str(tmp_path / "a.csv"), str(tmp_path / "b.csv")], most_headers=1)


def test_a_file_of_many_splits_is_read_by_many_tasks(spark, split, tmp_path):
    rows = [["id", "note"], *([str(i), f'line {i}\nof "{i % 7}", end' if i % 3 else "plain"] for i in range(20_000))]
    (tmp_path / "big.csv").write_text("\n".join(files.csv_line(r) for r in rows))
    split(20_000)
    assert splits.lines_of(spark, str(tmp_path)).rdd.getNumPartitions() > 20
    got = splits.read_table(spark, str(tmp_path)).orderBy("__rid").drop("__rid").collect()
    assert [list(r) for r in got] == rows[1:]

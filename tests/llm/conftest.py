import random

import pytest

#: Columns that clash with names the operators use themselves.
EXTRA = ["at", "doc", "kept", "digest", "shard", "label", "score", "fp", "n", "root", "file", "row"]
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, " + ", ".join(f"`{c}` string" for c in EXTRA)


def story(seed, words=60, lines=4):
    rng = random.Random(seed)
    out = ["".join(rng.choice(("ba", "ke", "lo", "mi", "ru", "ta", "ön", "ch")) for _ in range(rng.randint(1, 4))) for _ in range(words)]
    for i in rng.sample(range(1, words), lines - 1):
        out[i] = "\n" + out[i]
    return " ".join(out) + "."


def edge_rows():
    """(doc_id, text): nulls, empty and long texts, ties, repeated rows, a hot group, odd characters."""
    base = [story(i) for i in range(12)]
    rows = [
        (1, "A b\tc"), (2, "A  b c"), (None, "A b c"), (1, "A b\tc"), (3, None), (4, ""), (5, "   "), (None, None), (None, None),
        (6, " \n\t\n"), (7, story(99, 30_000, 400)), (8, "x" * 100_000), (9, "don't  stop now ▁ <s> <|endoftext|> \x00 \U0001f600 ﬁ"),
        (10, "Ünïcode line 　 wide"), (11, "same line\nsame line\nsame line"),
        (12, "Released under the MIT License. See the Apache License; the GNU General Public License, too."),
        (13, "you idiot, what a pathetic moron"), (14, "### *** $$$ %%% &&& ||| ### *** $$$ %%% &&& |||"),
        (15, "la la la la la la la la la la la la la la")]
    rows += [(100 + i, t) for i, t in enumerate(base)]
    rows += [(200 + i, "Shared head of many.\n" + t) for i, t in enumerate(base)]
    rows += [(300 + i, base[0]) for i in range(60)]                                   # a hot group of copies
    rows += [(400 + i, base[1].replace(" ", "  " if i % 2 else "\t")) for i in range(10)]
    rows += [(500 + i, base[2] + f" extra{i}") for i in range(10)]                    # near copies
    rows += [(600, base[3]), (600, base[3]), (600, base[4])]                          # repeated rows; one id, two texts
    return rows


def label_rows(rows):
    ids = sorted({i for i, _ in rows if i is not None})
    out = [(i, 0 if i in (14, 15, 8) or i % 17 == 0 else 1, 1 if i in (13,) or i % 11 == 0 else 0) for i in ids]
    return out + [(None, 1, 1), (out[0][0], None, None), (out[1][0], out[1][1], out[1][2])]


@pytest.fixture(scope="session")
def edge_dir(spark, tmp_path_factory):
    return write(spark, edge_rows(), tmp_path_factory.mktemp("edge"))


@pytest.fixture(scope="session")
def empty_dir(spark, tmp_path_factory):
    return write(spark, [], tmp_path_factory.mktemp("empty"))


def write(spark, rows, path):
    extra = tuple(None if i % 3 else c for i, c in enumerate(EXTRA))
    full = [(i, t, None if (i or 0) % 5 == 0 else "en", None, None if t is None else len(t), *extra) for i, t in rows]
    spark.createDataFrame(full, SCHEMA).repartition(3).write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame(label_rows(rows) if rows else [], "doc_id long, quality int, toxic int").write.parquet(f"{path}/labels.parquet")
    return str(path)

"""Queries against their SQL on rows that the driver's small tables do not have."""

import time

import duckdb
import pytest

from scrivener.plans import catalog


@pytest.fixture
def both(spark, tmp_path):
    """Sorted rows of a query and of its SQL over one table of given rows."""

    def run(name, table, schema, rows):
        spark.createDataFrame(rows, schema).coalesce(1).write.parquet(f"{tmp_path}/{table}.parquet")
        c = duckdb.connect()
        c.sql(f"create view {table} as select * from read_parquet('{tmp_path}/{table}.parquet/*.parquet')")
        df = catalog.queries()[name](spark, str(tmp_path))
        want = c.sql(f"select {', '.join(df.columns)} from ({catalog.oracle_sql()[name]})").fetchall()
        return sorted((tuple(r) for r in df.collect()), key=repr), sorted(want, key=repr)

    return run


def test_hints_at_other_letters(both):
    # a hint word behind a letter that is not ASCII, and cases of s and i beyond ASCII
    lines = ["Une échair", "aéditor", "xñboard", "chair", "achair", "Inſtitute of", "ınstıtute", "INSTİTUTE", "aſchool", "ſchool", "x, inſtitute", "Ann Lé", "Ann Ĺé"]
    found, want = both("o92_predict_lines", "documents", "doc_id long, text string, lang string, source string, n_chars long", [(1, "\n".join(lines), "en", "web", 9), (2, None, "en", "web", 0), (3, "", "en", "web", 0)])
    assert found == want
    assert [r[2] for r in sorted(found)[:4]] == ["Role-Label", None, "Role-Label", "Role-Label"]


def test_inline_tags_of_a_long_turn(both):
    # what stands in brackets before a line end is a word, and a turn's cost grows with its length
    texts = ["a <b>\n c <d> e", "<x> ", "", None, "a", "a  b <", "a b c d", "<e>  f", " ".join(f"w{i}" for i in range(6000))]
    start = time.monotonic()
    found, want = both("o109_inline_to_conll", "conversations", "conv_id long, turn long, role string, text string", [(1, i, "user", t) for i, t in enumerate(texts)])
    assert found == want
    assert time.monotonic() - start < 60


def test_first_of_equal_events(both):
    # ties of value and of id in any order of ids, no type, no value, both zeros, not-a-number
    nan, seen = float("nan"), []
    for user in range(40):
        seen += [(9, user, f"a{user % 3}", 5.0), (3, user, f"b{user % 5}", 5.0), (3, user, "c", 5.0), (1, user, None, 7.0), (None, user, "d", 4.0), (30, user, "e", None)]
    seen += [(2, 50, "x", 0.0), (1, 50, "y", -0.0), (4, 51, "x", -0.0), (5, 51, "y", 0.0), (6, 52, "x", nan), (5, 52, "y", nan), (7, 52, "z", float("inf")), (8, 53, None, 1.0), (9, None, "n", -1.0), (8, None, "m", -1.0)]
    found, want = both("o122_o123_first_and_argmax", "events", "event_id long, user_id long, event_type string, value double", seen)
    assert found == want
    assert found[0] == (0, "b0", "a0")

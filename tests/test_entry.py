"""The entry points, and that nothing outside imports the subpackage for training data."""

import os
import re

import __spark_entry__

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))


def test_entry(spark):
    assert __spark_entry__.entry(spark).columns == ["gram", "occ"]


def test_names_agree():
    queries, sql = __spark_entry__.queries(), __spark_entry__.oracle_sql()
    assert set(sql) <= set(queries) and len(queries) > 70


def test_library_does_not_need_the_subpackage():
    for top, _, files in os.walk(os.path.join(ROOT, "runeframe")):
        if os.path.basename(top) == "llm":
            continue
        for name in files:
            if name.endswith(".py"):
                assert not re.search(r"runeframe[. ]+(import )?llm", open(os.path.join(top, name)).read()), name

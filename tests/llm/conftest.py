"""Documents with everything that may be wrong with them."""

import random
import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parent))

from llm_fixtures import SCHEMA, prose  # noqa: E402

@pytest.fixture(scope="session")
def make_docs(spark):
    """Rows (doc_id, text, source) as a table of documents with columns whose names operators use inside."""

    def make(rows):
        full = [(i, t, "en", s, None if t is None else len(t), 1, "x", 2, 3, "y", 4, "z", 5) for i, t, s in rows]
        return spark.createDataFrame(full, SCHEMA)

    return make


@pytest.fixture(scope="session")
def awkward(make_docs):
    """Rows of awkward documents, as (table, rows)."""
    rng = random.Random(5)
    base = prose(rng, 220)
    w = base.split()
    rows = [(i, prose(rng, rng.choice((1, 3, 4, 5, 9, 60, 200))), f"s{i % 4}") for i in range(40)]
    rows += [(100, base, "s0"), (101, base, "s1"), (102, base.upper(), None), (103, base.replace(" ", "\n\t "), "s0")]
    for i in range(12):  # near copies at several distances
        edited = list(w)
        for k in range(i):
            edited[(k * 37 + i * 11) % len(w)] = f"edit{i}x{k}"
        rows.append((110 + i, " ".join(edited), "s2"))
    rows += [(130 + i, prose(rng, 30 + 20 * i) + " " + " ".join(w[40:120]) + " " + prose(rng, 40), "s3") for i in range(5)]
    rows += [(200, None, "s0"), (201, "", "s1"), (202, " \n\t ", "s1"), (203, None, None), (None, base, "s2"), (None, None, "s2"), (None, "lonely words of nobody else", "s1")]
    rows += [(300, "twice the same row here", "s0")] * 2 + [(301, "one id", "s0"), (301, "another text of that id", "s1")]
    rows += [(400, prose(rng, 30_000), "s3"), (401, "ünïcode stays " * 30 + "İß😀", "s2"), (402, "x" * 100_000, "s1"), (403, "a b\x85c \x1c d", "s1")]
    return make_docs(rows), rows

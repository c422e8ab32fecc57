import math
import random
import re
from collections import Counter

import duckdb
import pytest
from pyspark.sql import functions as F

from tests.llm.conftest import rows_of

from halfstar.llm import queries, secrets


def brute_base(text):
    spans = []
    for m in re.finditer(r"""((?a:(?i:password|passwd|secret|token|api_?key)))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", text):
        if len(m[2]) >= 12:
            spans.append((m.start(), m.end(), "assign"))
    spans += [(*m.span(), "access") for m in re.finditer("AKIA[A-Z0-9]+", text) if len(m[0]) >= 18]
    return spans + [(*m.span(), "hex") for m in re.finditer("[0-9a-f]+", text) if len(m[0]) >= 16]


def brute_entropy(text):
    """Places of the windows that are high and hold nothing allowed."""
    cover = set()
    for m in re.finditer(secrets.CANDIDATE, text):
        s = m[0]
        if not re.search("[0-9]", s) or not re.search("[A-Za-z]", s):
            continue
        least = 2.8 if re.fullmatch("[0-9a-fA-F]+", s) else 3.5
        off = {i for p in secrets.ALLOWED for a in re.finditer(p.replace(r"\z", r"\Z"), s) for i in range(*a.span())}
        for i in range(len(s) - 15):
            bits = -sum(n / 16 * math.log2(n / 16) for n in Counter(s[i : i + 16]).values())
            if bits >= least - 1e-9 and not off & set(range(i, i + 16)):
                cover |= set(range(m.start() + i, m.start() + i + 16))
    return cover


def runs(places):
    out = []
    for i in sorted(places):
        if out and out[-1][1] == i:
            out[-1][1] = i + 1
        else:
            out.append([i, i + 1])
    return [(a, b, "entropy") for a, b in out if b - a >= 16]


def brute(text):
    """The patterns' matches, and what high windows cover beside them."""
    base = brute_base(text or "")
    return base, runs(brute_entropy(text or "") - {i for a, b, _ in base for i in range(a, b)})


@pytest.fixture(scope="module")
def texts():
    rng = random.Random(4)
    parts = ["password", 'Token"', "api_key", "APIKEY", " = ", ":", "'", "AKIA", "x", "deadbeef0123", "Zq9+/x", "\n", "é😀", "secret=", "a1B2c3D4e5F6g7H8i9J0k1"]
    out = ["".join(rng.choice(parts) for _ in range(rng.randint(1, 14))) for _ in range(1500)]
    out += ["".join(rng.choice("0123456789abcdefABxyz+/") for _ in range(rng.randint(18, 90))) for _ in range(400)]
    out += ["token=secret: abcdefghijklmnop", "AKIA" + "Z" * 14, "AKIA" + "Z" * 13, "ab1" * 4000, "550e8400-e29b-41d4-a716-446655440000", "myexample1A2b3C4d5E6f7G8"]
    return out


def test_against_a_plain_search(make_docs, texts):
    got = secrets.find_secrets(make_docs(rows_of(texts))).orderBy("doc_id").collect()
    for text, row in zip(texts, got):
        assert ([tuple(s) for s in row.base], [tuple(s) for s in row.added]) == brute(text), text
    assert sum(len(r.added) for r in got) > 50


def test_hard_cases(hard_docs, no_docs):
    rows = hard_docs.collect()
    got = secrets.find_secrets(hard_docs)
    assert got.columns == ["doc_id", "base", "added"] and got.count() == len(rows)
    assert got.where((F.size("base") > 0) | (F.size("added") > 0)).count() == 0
    assert secrets.find_secrets(no_docs).count() == 0


def test_native(hard_docs):
    plan = secrets.find_secrets(hard_docs)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Exchange" not in plan


def test_sql_on_texts_where_entropy_decides(spark, make_docs, texts, tmp_path):
    """The SQL beside the query, on texts with hundreds of added spans."""
    make_docs(rows_of([*texts, None])).write.parquet(f"{tmp_path}/documents.parquet")
    con = duckdb.connect()
    con.execute(f"create view documents as select * from '{tmp_path}/documents.parquet/*.parquet'")
    mine = queries.op1(spark, str(tmp_path))
    columns = ", ".join(mine.columns)
    theirs = con.execute(f"select {columns} from ({queries.SECRETS_SQL}) order by doc_id").fetchall()
    assert [tuple(r) for r in mine.orderBy("doc_id").collect()] == theirs
    assert sum(r[-1] for r in theirs) > 50

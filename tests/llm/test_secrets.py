"""The Markov models on strings they weren't trained on, and many matches in one text."""

from __future__ import annotations

import hashlib
import time
from base64 import b64encode

from pyspark.sql import functions as F

from cartomill.llm import secrets

ORDINARY = """l_extendedprice l_shipinstruct o_orderpriority ps_availqty n_regionkey c_mktsegment getElementByIdentifier
parse_configuration_file initialise_database_connection MAXIMUM_RETRY_COUNTER BackgroundJobScheduler renderTemplateFragment
documentation/getting-started/installation asynchronous_result_collector temperature_sensor_reading compressionAlgorithmName
characteristically Wissenschaftlerinnen Geschwindigkeitsbegrenzung anticonstitutionnellement desproporcionadamente
administrativement Selbstverwirklichung internacionalizaciones industrial_production_estimate quarterly_revenue_breakdown""".split()


def test_markov_on_held_out_strings(spark):
    random = [f(hashlib.blake2b(f"held{i}".encode()).digest()) for i in range(40) for f in (lambda d: d.hex()[:23].upper(), lambda d: "".join(c for c in b64encode(d).decode() if c.isalnum())[:32])]
    random = [r for r in random if any(c.isdigit() for c in r) and any(c.isalpha() for c in r)]
    rows = [(i, w, 0) for i, w in enumerate(ORDINARY) if len(w) >= 16] + [(1000 + i, w, 1) for i, w in enumerate(random)]
    got = secrets.scan(spark.createDataFrame(rows, "doc_id long, text string, y int"), secrets.default_ratios(spark)).select("y", (F.size("spans") > 0).cast("int").alias("hit")).toPandas()
    recall, false = got[got.y == 1].hit.mean(), got[got.y == 0].hit.mean()
    precision = got[got.hit == 1].y.mean()
    assert recall >= 0.95 and precision >= 0.95 and false <= 0.1, (recall, precision, false)


def test_many_matches(spark):
    """Time grows little faster than the number of matches, and spans are those of single keys."""
    ratios = secrets.default_ratios(spark)

    def run(n):
        keys = [hashlib.md5(str(i).encode()).hexdigest()[:24] for i in range(n)]
        began = time.time()
        row = secrets.scan(spark.createDataFrame([(1, " ".join(keys))], "doc_id long, text string"), ratios).select("base", "spans").first()
        assert [(x.s, x.k, x.e) for x in row.base] == [(25 * i, 2, 25 * i + 24) for i in range(n)] == [(x.s, x.k, x.e) for x in row.spans]
        return time.time() - began

    run(200)
    assert run(20_000) < 10


def test_overlaps(spark):
    """Tokens around base spans are left out, those beside them stay, in blocks as in single ones."""
    part = "token=" + "Zk3qXv9PwB7tRm2LdY5hNc8J " + "qX7vZk3PwB9tRm2LdY5hNc8J "
    ratios = secrets.default_ratios(spark)
    one = secrets.scan(spark.createDataFrame([(1, part)], "doc_id long, text string"), ratios).select("base", "spans").first()
    many = secrets.scan(spark.createDataFrame([(1, part * 700)], "doc_id long, text string"), ratios).select("base", "spans").first()
    assert len(one.base) == 1 and len(one.spans) == 2
    assert [(x.s, x.k, x.e) for x in many.spans] == [(x.s + i * len(part), x.k, x.e + i * len(part)) for i in range(700) for x in one.spans]

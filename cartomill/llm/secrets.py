"""Secret scan, in DataFrame functions only.

Patterns find assigned secrets, access keys and long hex strings.  A pair of
character Markov models, one of random strings and one of ordinary
identifiers, trained from labelled samples, adds tokens whose log-likelihood
ratio says random.
"""

from __future__ import annotations

import hashlib
import itertools
import math
from base64 import b64encode

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from cartomill.llm.common import let, table

ASSIGN = r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]{16,}"
HEX = r"[0-9a-f]{24,}"
KINDS = ("assign", "access", "hex", "markov")
#: Tokens that the Markov models judge, and their alphabet.
TOKEN = r"(?<![\p{L}\p{N}+/_=-])[A-Za-z0-9+/_=-]{16,}(?![\p{L}\p{N}+/_=-])"
ALPHABET = "abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789+/_=-"
#: Nats for each character by which random must be likelier.
MARGIN = 0.6

PARTS = """the user account order line item total price count index value name file path table column row key type
group list map node edge graph tree block page cache store load save read write open close start stop create delete
update insert select filter sort merge split join left right outer inner first last next previous begin end min max sum
mean median request response client server host port address message queue event handler listener manager factory
builder parser reader writer config option default parameter argument result error warning status code version release
build test check validate verify compute process thread worker task schedule timer date time year month week day hour
region nation city street house water forest river mountain summer winter international understanding responsibility
der die und nicht schaft keit heit ung chen lich les des ment tion ance eau que para con los las cion mente idad""".split()


def labelled_samples(n: int = 1500) -> list[tuple[str, int]]:
    """(text, 1 random or 0 ordinary), from a rule: hashes in several alphabets; words joined as identifiers are."""
    out = []
    for i in range(n):
        d = hashlib.sha512(str(i).encode()).digest()
        b64 = b64encode(d).decode()
        out += [(d.hex()[: 16 + i % 48], 1), (b64[: 16 + i % 48], 1), ("".join(c for c in b64 if c.isalnum())[: 16 + i % 48], 1), ("".join(c for c in b64 if c.isalnum()).upper()[: 16 + i % 24], 1)]
        w = [PARTS[d[j] % len(PARTS)] for j in range(2 + d[9] % 4)]
        num = str(int.from_bytes(d[:8], "big"))[: 1 + d[10] % 16]
        out += [("_".join(w), 0), ("-".join(w), 0), ("".join(w), 0), ("".join(x.title() for x in w), 0), ("_".join(w).upper(), 0)]
        out += [("/".join(w) + num[:2], 0), (w[0] + "_" + num[:4], 0), (num, 0), (num[:4] + "-" + num[4:6] + "-" + num[6:8], 0), ("=" * len(w) * 4, 0), ("-" * len(w) * 6, 0)]
    return out


def train(samples: DataFrame) -> list[float]:
    """Log-likelihood ratios random : ordinary of each pair (character before or start, character), row by row.

    samples: (text string, label int).  Counts get 0.5 added; null texts or labels and
    characters outside ALPHABET count for nothing.  The table has a fixed size.
    """
    n = len(ALPHABET) + 1
    at = lambda c: F.instr(F.lit(ALPHABET), c)
    pairs = (
        samples.where("text is not null and label is not null and length(text) > 0")
        .select("label", F.explode(F.transform(F.sequence(F.lit(1), F.length("text")), lambda i: F.struct(F.when(i > 1, at(F.substr("text", F.greatest(i - 1, F.lit(1)), F.lit(1)))).otherwise(0).alias("a"), at(F.substr("text", i, F.lit(1))).alias("b")))).alias("p"))
        .where("p.b > 0").groupBy("label", "p.a", "p.b").count().collect()
    )
    count = {(r["label"], r["a"], r["b"]): r["count"] for r in pairs}
    total = {(y, a): sum(count.get((y, a, b), 0) for b in range(1, n)) for y in (0, 1) for a in range(n)}
    logp = lambda y, a, b: math.log((count.get((y, a, b), 0) + 0.5) / (total[y, a] + 0.5 * (n - 1)))
    return [0.0 if b == 0 else logp(1, a, b) - logp(0, a, b) for a, b in itertools.product(range(n), range(n))]


def _ratio(token: Column, ratios: list[float]) -> Column:
    n = len(ALPHABET) + 1
    looked = F.split(F.lit(",".join(f"{x:.4f}" for x in ratios)), ",").cast("array<double>")
    code = lambda i: F.instr(F.lit(ALPHABET), F.substr(token, i, F.lit(1)))
    start = F.struct(F.lit(0).alias("a"), F.lit(0.0).alias("s"))

    def step(acc: Column, i: Column) -> Column:
        return F.struct(code(i).alias("a"), (acc["s"] + F.get(looked, acc["a"] * n + code(i))).alias("s"))

    return F.aggregate(F.sequence(F.lit(1), F.length(token)), start, step)["s"] / F.length(token)


#: Matches of a text are dealt into blocks of so many, so that the work grows little faster than their number.
BLOCK = 128
SPANS = "array<struct<s:int,k:int,e:int>>"


def _blocks(array: Column) -> Column:
    none = F.slice(array, 1, 0)
    return F.when(F.size(array) > 0, F.transform(F.sequence(F.lit(0), F.floor((F.size(array) - 1) / BLOCK).cast("int")), lambda j: F.slice(array, j * BLOCK + 1, F.lit(BLOCK)))).otherwise(F.slice(F.array(none), 1, 0))


def _spans(text: Column, pattern: str, kind: int, keep) -> Column:
    """All matches that keep(match, group 2) lets pass, as structs (start, kind, end) in code points."""
    whole = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    inner = F.regexp_extract_all(text, F.lit(pattern), F.lit(2)) if pattern is ASSIGN else whole
    both = F.struct(inner.alias("inner"), F.split(text, pattern, -1).alias("gaps"))
    one = lambda b, m, i: F.struct(F.length(F.get(b["gaps"], i)).alias("gap"), F.length(m).alias("len"), keep(m, F.get(b["inner"], i)).alias("ok"))
    each = let(both, lambda b: F.transform(whole, lambda m, i: one(b, m, i)))

    def step(acc: Column, x: Column) -> Column:
        s, e = acc["at"] + x["gap"], acc["at"] + x["gap"] + x["len"]
        one = F.array(F.struct(s.alias("s"), F.lit(kind).alias("k"), e.alias("e")))
        return F.struct(e.alias("at"), F.when(x["ok"], F.concat(acc["out"], one)).otherwise(acc["out"]).alias("out"))

    def placed(blocks: Column) -> Column:
        """Each block's spans, from where the blocks before it end."""
        sizes = F.transform(blocks, lambda b: F.aggregate(b, F.lit(0), lambda n, x: n + x["gap"] + x["len"]))
        start = lambda z, j: F.aggregate(F.slice(z, 1, j), F.lit(0), lambda n, x: n + x)
        spans = lambda b, at: F.aggregate(b, F.struct(at.alias("at"), F.lit([]).cast(SPANS).alias("out")), step)["out"]
        return let(sizes, lambda z: F.flatten(F.transform(blocks, lambda b, j: spans(b, start(z, j)))))

    return let(let(each, _blocks), placed)


def _apart(tokens: Column, base: Column) -> Column:
    """Those of ``tokens`` that overlap none of ``base``, which is sorted."""
    overlap = lambda t, b: (b["s"] < t["e"]) & (t["s"] < b["e"])
    # spans of several kinds may lie in each other, so a block ends where the farthest of its spans does
    ranged = F.transform(_blocks(base), lambda b: F.struct(F.get(b, F.lit(0))["s"].alias("s"), F.array_max(F.transform(b, lambda x: x["e"])).alias("e"), b.alias("of")))
    return let(ranged, lambda blocks: F.filter(tokens, lambda t: ~F.exists(blocks, lambda x: overlap(t, x) & F.exists(x["of"], lambda b: overlap(t, b)))))


def _listed(spans: Column) -> Column:
    names = F.array(*[F.lit(k) for k in KINDS])
    return F.array_join(F.transform(spans, lambda x: F.concat_ws(":", F.get(names, x["k"]), x["s"].cast("string"), x["e"].cast("string"))), ",")


def scan(docs: DataFrame, ratios: list[float], text_col: str = "text") -> DataFrame:
    """Adds base and spans (arrays of (s, k, e), by start, then kind; k indexes KINDS) to ``docs``.

    Null or empty text: no spans.  Markov spans that overlap a base span are left out.
    The whole text is scanned, however long.  Columns base, spans, _assign, _access, _hex and
    _token are this function's own: those of ``docs`` are replaced.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    none = F.lit([]).cast(SPANS)
    low = F.lower(text)
    words = ("password", "passwd", "secret", "token", "apikey", "api_key")
    hint = F.lit(False)
    for w in words:
        hint = hint | F.contains(low, F.lit(w))
    yes = lambda m, g: F.lit(True)
    found = docs.withColumns(
        {
            "_assign": F.when(hint, _spans(text, ASSIGN, 0, lambda m, g: F.length(g) >= 6)).otherwise(none),
            "_access": F.when(F.contains(text, F.lit("AKIA")), _spans(text, ACCESS, 1, yes)).otherwise(none),
            "_hex": F.when(text.rlike(HEX), _spans(text, HEX, 2, yes)).otherwise(none),
            "_token": F.when(text.rlike(TOKEN), _spans(text, TOKEN, 3, lambda m, g: _ratio(m, ratios) > MARGIN)).otherwise(none),
        }
    )
    base = F.array_sort(F.concat("_assign", "_access", "_hex"))
    apart = F.when((F.size("_token") > 0) & (F.size("base") > 0), _apart(F.col("_token"), F.col("base"))).otherwise(F.col("_token"))
    return found.withColumn("base", base).withColumn("spans", F.array_sort(F.concat("base", apart))).drop("_token")


def default_ratios(spark: SparkSession) -> list[float]:
    return train(spark.createDataFrame(labelled_samples(), "text string, label int"))


def op2_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = scan(table(spark, sf_dir, "documents").select("doc_id", "text"), default_ratios(spark))
    return found.select(
        "doc_id",
        *[F.size(f"_{k}").cast("long").alias(f"n_{k}") for k in ("assign", "access", "hex")],
        F.sha2(_listed(F.col("base")).cast("binary"), 256).alias("base_sha256"),
        _listed(F.col("spans")).alias("spans"),
    )

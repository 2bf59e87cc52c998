"""Personal data and revealing terms against plain Python and SQL."""

import hashlib
import math
import random
import re
from collections import Counter, defaultdict

import duckdb
import pyarrow as pa
import pytest
from oracle import differences
from pyspark.sql import functions as F

from panelworks.llm import disclosure
from panelworks.llm.disclosure import BASE, KINDS, SQL, find_personal_data, sanitised

EMAIL = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
IP = re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")
CARD = re.compile(r"[0-9]([\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
TOKEN = re.compile(r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+|(?<![0-9])[0-9]+(?:\.[0-9]+){3}|[0-9](?:[ -]?[0-9]){11,}|\+[0-9][\x20().0-9-]+[0-9]|[^\W\d_]+")


def luhn(digits):
    return sum(sum(divmod(2 * int(d), 10)) if k % 2 else int(d) for k, d in enumerate(reversed(digits))) % 10 == 0


def digits(value):
    return re.sub("[^0-9]", "", value)


VALID = {
    "email": lambda v: True,
    "ip": lambda v: all(int(p) <= 255 for p in v.split(".")),
    "card": lambda v: 12 <= len(digits(v)) <= 19 and luhn(digits(v)),
    "phone": lambda v: 9 <= len(digits(v)) <= 15,
}


def base(text):
    return [(m.start(), BASE.index(k), m.end()) for k, r in zip(BASE, (EMAIL, IP, CARD, PHONE), strict=True) for m in r.finditer(text or "") if VALID[k](m[0])]


def entity(value):
    kind = "email" if "@" in value else "phone" if value[0] == "+" else "ip" if "." in value else "card"
    return f"{kind}:{value.lower() if kind == 'email' else value if kind == 'ip' else digits(value)}" if VALID[kind](value) else None


def expected(texts):
    """Spans of each text, with the logarithms of the method."""
    passages = []
    for text in texts:
        tokens = [m[0] for m in TOKEN.finditer(text or "")]
        for at in range(0, len(tokens), 64):
            part = tokens[at : at + 64]
            words = frozenset(t.lower() for t in part if t[0].isalpha() and "@" not in t)
            passages.append((frozenset(filter(None, (entity(t) for t in part if not t[0].isalpha() or "@" in t))), words))
    n = len(passages)
    n_term, n_entity, n_kind, n_both, kinds_of = Counter(), Counter(), Counter(), Counter(), defaultdict(set)
    for entities, words in passages:
        n_term.update(words)
        n_entity.update(entities)
        n_kind.update({e.split(":")[0] for e in entities})
        for e in entities:
            for w in words:
                n_both[e, w] += 1
                kinds_of[e, w].add((entities, words))
    tells = {}
    for (e, w), both in n_both.items():
        if len(kinds_of[e, w]) >= 3:
            told = math.log2(both * n / (n_entity[e] * n_term[w]))
            if told > math.log2(n / n_kind[e.split(":")[0]]) + 1e-9:
                tells[e, w] = 4 if told >= math.log2(n / n_entity[e]) - 1 - 1e-9 else 5
    out = []
    for text in texts:
        spans, held = base(text), {f"{BASE[k]}:{(text[s:e].lower() if k == 0 else text[s:e] if k == 1 else digits(text[s:e]))}" for s, k, e in base(text)}
        taken = list(spans)
        for m in TOKEN.finditer(text or ""):
            ranks = [tells[e, m[0].lower()] for e in held if (e, m[0].lower()) in tells]
            if m[0][0].isalpha() and "@" not in m[0] and ranks and not any(s < m.end() and m.start() < e for s, _, e in taken):
                spans.append((m.start(), min(ranks), m.end()))
        out.append(sorted(spans))
    return out


def some_texts(seed=2):
    rng = random.Random(seed)
    common = "the of and in to was here there always never people house wind Straße été niño".split()
    texts = []
    for k in range(240):
        words = [rng.choice(common) for _ in range(rng.randint(5, 150))]
        if k % 4 == 0:
            words[1:1] = [f"call{k}", "+1 (386) 555-3733" if k % 8 else "anna.Smith@host.example.org", "Tuareg" if k % 3 else "Kestrel", "harbour"]
        elif k % 10 == 1:
            words += ["harbour", "10.1.2.3", "4041894974608795"]
        elif k % 10 == 2:
            words += ["Kestrel", "Quillon", "nobody@nowhere.example.com", rng.choice(["+49 30 1234567", "555.1.1.1", "1.2.3.4.5.6.7.8", "4041-8949 7460 8796", "a@b", "@x.y"])]
        texts.append(rng.choice([" ", " ", "\n"]).join(words))
    texts += texts[:9] * 2
    return texts


ODD = [
    None, "", " \n\t ", "a@b.c@d.e a@b.com-x+y@d.e", "+1 386 555 3733 and +1 386 555 3733x", "1.2.3.4.5 256.1.1.1 001.002.003.004 99999999999999999999.1.1.1",
    "4041 8949 7460 8795 4041894974608795-", "ß🙂é anna@host.org 🙂 10.0.0.1", "." * 50 + "@" * 50, "x.y-z%w+q@a-b.c", "+1 (((( 2 +12345678901234567890 +1 23456789", "İstanbul a@b.tr",
]


def checked(spark, texts):
    rows = [(k, t) for k, t in enumerate(texts)]
    found = find_personal_data(spark.createDataFrame(rows, "doc_id long, text string").repartition(3)).collect()
    got = {r["doc_id"]: [(s["start"], s["rank"], s["end"]) for s in r["spans"]] for r in found}
    assert len(found) == len(rows)
    for k, want in enumerate(expected(texts)):
        assert got[k] == want, (k, texts[k])
    return got


def test_spans_against_plain_python(spark):
    got = checked(spark, some_texts() + ODD)
    ranks = Counter(rank for spans in got.values() for _, rank, _ in spans)
    assert all(ranks[k] for k in range(len(KINDS))), ranks


def test_query_columns_against_sql(spark, tmp_path):
    rows = [(k, t) for k, t in enumerate(some_texts(3) + ODD[:-1])]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    con = duckdb.connect()
    con.register("documents", pa.table({"doc_id": [r[0] for r in rows], "text": [r[1] for r in rows]}))
    result = disclosure.op13_disclosure(spark, str(tmp_path))
    assert not differences(result.toArrow(), con.sql(SQL).to_arrow_table())
    empty = {r["doc_id"]: (r["base_sha256"], r["spans"]) for r in result.collect()}[len(rows) - len(ODD) + 1]
    assert empty == (hashlib.sha256(b"").hexdigest(), "")
    plan = result._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan


def test_sanitised_texts(spark):
    texts = some_texts()
    found = find_personal_data(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"))
    clean = {r["doc_id"]: r["text"] for r in sanitised(found).collect()}
    for k, spans in enumerate(expected(texts)):
        parts, at = [], 0
        for s, rank, e in spans:
            if s >= at:
                parts += [texts[k][at:s], "[]" if rank == 4 else f"[{KINDS[rank]}]"]
            at = max(at, e)
        assert clean[k] == "".join(parts) + texts[k][at:]
    assert "anna" not in "".join(clean.values()).lower()


def test_repeated_rows_extra_columns_and_empty_tables(spark):
    texts = some_texts()[:40]
    rows = [(1, t) for t in texts] * 2 + [(None, texts[0])]
    wide = spark.createDataFrame(rows, "doc_id long, text string").select("*", F.lit(1).alias("h1"), F.lit("x").alias("spans"), F.lit(3).alias("kind"), F.lit("t").alias("term"))
    found = find_personal_data(wide).collect()
    want = Counter((t, str(s)) for t, s in zip([t for _, t in rows], expected([t for _, t in rows]), strict=True))
    assert Counter((r["text"], str([(s["start"], s["rank"], s["end"]) for s in r["spans"]])) for r in found) == want
    assert find_personal_data(wide.limit(0)).count() == 0


def test_very_long_texts(spark):
    texts = ["a" * 2_000_000, "a." * 500_000 + "@", "x@" + "y." * 300_000 + "z", "1" * 1_000_000, "1 " * 400_000, "+1" + " " * 1_000_000, "1.2.3." * 200_000, "anna@host.org " * 20_000]
    rows = find_personal_data(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).select("doc_id", F.size("spans").alias("n")).collect()
    assert {r["doc_id"]: r["n"] for r in rows} == {0: 0, 1: 0, 2: 1, 3: 0, 4: 0, 5: 0, 6: 150_000, 7: 20_000}


@pytest.mark.parametrize("value, fine", [("4041894974608795", True), ("4041894974608796", False), ("1234", False), ("0" * 19, True), ("0" * 20, False)])
def test_luhn(spark, value, fine):
    assert spark.range(1).select(disclosure._valid("card", F.lit(value))).first()[0] == fine

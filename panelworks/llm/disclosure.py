r"""Personal data, and the terms that give it away (information-theoretic sanitisation), in SQL functions alone.

1. Base: addresses, IP numbers, payment cards and phone numbers by pattern and check (parts, Luhn, digits). Each valid match
   is an occurrence of a protected entity c, of a kind g: ``email:anna@host.org`` is one, all its occurrences together.
2. Texts are cut into passages of PASSAGE tokens (entities and words). With N passages, n(x) of them holding x and n(c, t)
   holding both, a term t tells PMI(c;t) = log2(n(c,t) N / (n(c) n(t))) bits about c. Knowing only that an entity of the
   kind is there tells IC(g) = log2(N / n(g)) bits. In a document that holds c, a term that tells more than IC(g) is a
   ``hint``, to be generalised; one that leaves at most one bit open, PMI(c;t) >= IC(c) - 1, that is n(c,t) / n(t) >= 1/2, is
   a ``term``, to be removed. Evidence is needed from SUPPORT different passages, so that copies prove nothing. Both
   inequalities are compared as products of whole numbers.
3. Documents without an entity are left alone: nothing is there to disclose.

Matches are located by the lengths of what lies between them, summed by a window per text. All counts are sums before the
shuffle; texts are told apart by 128 bits of hashes and copies are located once. A passage bounds the pairs of an entity and
a term, however long a line or text is. Patterns are possessive: linear in the text, and no recursion in the engine.

Defined cases: a null text is empty; empty texts have no spans; rows are judged each for itself, equal ones alike; null ids
stay; extra columns are ignored; an empty table gives an empty result. Spans of the method that meet a base span are left out.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from panelworks.llm.catalogue import read, registered
from panelworks.scale import cut_lineage

_LOCAL = "[A-Za-z0-9._%+-]"
_DOMAIN = r"[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++"
# A match may begin where no character of the local part stands before it, or where the last match ended: every later start in
# the same run of characters meets the same end.
EMAIL = rf"(?:(?<!{_LOCAL})|\G){_LOCAL}++@{_DOMAIN}"
IP = r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++"
CARD = r"[0-9](?:[ -]?[0-9])++"
PHONE = r"\+[0-9][ ().0-9-]+[0-9]"
PATTERNS = {"email": EMAIL, "ip": IP, "card": CARD, "phone": PHONE}
BASE = tuple(PATTERNS)
KINDS = (*BASE, "term", "hint")
# Cheap conditions that hold wherever a pattern has a valid match.
GATES = {"email": "@", "ip": r"[0-9]\.[0-9]++\.[0-9]++\.[0-9]", "card": "[0-9](?:[ -]?[0-9]){11}", "phone": "+"}

TOKEN = rf"(?<!{_LOCAL}){_LOCAL}++@{_DOMAIN}|{IP}|[0-9](?:[ -]?[0-9]){{11,}}+|{PHONE}|\p{{L}}++"
PASSAGE, SUPPORT = 64, 3

_PART = "0*(?:25[0-5]|2[0-4][0-9]|[01]?[0-9]?[0-9])"


def _digits(value: Column) -> Column:
    return F.regexp_replace(value, "[^0-9]", "")


def _luhn(value: Column) -> Column:
    back = F.reverse(_digits(value))
    digit = lambda i: F.substring(back, i, F.lit(1)).cast("int")
    twice = lambda d: 2 * d - F.when(d > 4, 9).otherwise(0)
    total = F.aggregate(F.sequence(F.lit(1), F.length(back)), F.lit(0), lambda s, i: s + F.when(i % 2 == 0, twice(digit(i))).otherwise(digit(i)))
    return total % 10 == 0


def _valid(kind: str, value: Column) -> Column:
    count = F.length(_digits(value))
    return {
        "email": F.lit(True),
        "ip": value.rlike(rf"^{_PART}(?:\.{_PART}){{3}}$"),
        # The sum is only formed where the length fits.
        "card": F.when(count.between(12, 19), _luhn(value)).otherwise(False),
        "phone": count.between(9, 15),
    }[kind]


def _entity(kind: str, value: Column) -> Column:
    """Name of the protected entity: letters fold, separators do not count."""
    return F.concat(F.lit(f"{kind}:"), {"email": F.lower(value), "ip": value}.get(kind, _digits(value)))


def _gate(kind: str, text: Column) -> Column:
    return F.contains(text, F.lit(GATES[kind])) if len(GATES[kind]) == 1 else text.rlike(GATES[kind])


def _any_gate(text: Column) -> Column:
    found = _gate(BASE[0], text)
    for kind in BASE[1:]:
        found = found | _gate(kind, text)
    return found


def _texts(documents: DataFrame) -> DataFrame:
    text = F.coalesce("text", F.lit(""))
    return documents.select("doc_id", F.xxhash64(text).alias("h1"), F.xxhash64(text, F.lit(1)).alias("h2"), text.alias("text"))


def _located(rows: DataFrame, pieces: Column, matches: Column) -> DataFrame:
    """(h1, h2, kind, value, start, end): where each match stands, from what lies between matches; once for equal texts."""
    n = F.size("matches")
    lengths = F.transform(F.slice("pieces", F.lit(1), n), F.length)
    listed = rows.select("h1", "h2", "kind", pieces.alias("pieces"), matches.alias("matches")).filter(F.size("matches") > 0)
    each = listed.select("h1", "h2", "kind", F.posexplode(F.arrays_zip(lengths.alias("gap"), F.col("matches").alias("value"))).alias("place", "item"))
    once = each.groupBy("h1", "h2", "kind", "place").agg(F.first("item").alias("item"))
    so_far = Window.partitionBy("h1", "h2", "kind").orderBy("place")
    end = F.sum(F.col("item.gap") + F.length("item.value")).over(so_far)
    return once.select("h1", "h2", "kind", F.col("item.value").alias("value"), end.alias("end")).select(
        "h1", "h2", "kind", "value", (F.col("end") - F.length("value")).alias("start"), "end"
    )


def base_spans(texts: DataFrame) -> DataFrame:
    """(h1, h2, kind, entity, start, end) of every valid match, in code points, end exclusive."""
    found = None
    for kind, pattern in PATTERNS.items():
        rows = texts.filter(_gate(kind, F.col("text"))).withColumn("kind", F.lit(kind))
        one = _located(rows, F.split("text", pattern, -1), F.regexp_extract_all("text", F.lit(pattern), F.lit(0)))
        one = one.filter(_valid(kind, F.col("value"))).select("h1", "h2", "kind", _entity(kind, F.col("value")).alias("entity"), "start", "end")
        found = one if found is None else found.unionByName(one)
    return found


def _passages(texts: DataFrame) -> DataFrame:
    """(tokens): passages of PASSAGE tokens of every text."""
    tokens = F.regexp_extract_all("text", F.lit(TOKEN), F.lit(0))
    cuts = F.transform(F.sequence(F.lit(1), F.size("tokens"), F.lit(PASSAGE)), lambda k: F.slice("tokens", k, PASSAGE))
    return texts.select(tokens.alias("tokens")).filter(F.size("tokens") > 0).select(F.explode(cuts).alias("tokens"))


def _is_word(token: Column) -> Column:
    return token.rlike(r"^\p{L}")


def _words(tokens: Column) -> Column:
    """Distinct terms of a passage, in order; an address begins with a letter, too, but has a sign that words lack."""
    return F.array_sort(F.array_distinct(F.transform(F.filter(tokens, lambda t: _is_word(t) & ~F.contains(t, F.lit("@"))), F.lower)))


def _entities(tokens: Column) -> Column:
    value = lambda t: (
        F.when(F.contains(t, F.lit("@")), _entity("email", t))
        .when(F.startswith(t, F.lit("+")), F.when(_valid("phone", t), _entity("phone", t)))
        .when(F.contains(t, F.lit(".")), F.when(_valid("ip", t), _entity("ip", t)))
        .otherwise(F.when(_valid("card", t), _entity("card", t)))
    )
    return F.array_sort(F.array_compact(F.array_distinct(F.transform(F.filter(tokens, lambda t: ~_is_word(t) | F.contains(t, F.lit("@"))), value))))


def revealing_terms(texts: DataFrame) -> DataFrame:
    """(entity, term, kind, bits, bound): terms that tell more about an entity than its kind does."""
    near = _passages(texts.filter(_any_gate(F.col("text")))).select(_entities(F.col("tokens")).alias("entities"), _words(F.col("tokens")).alias("words")).filter(F.size("entities") > 0)
    # Passages of the same entities and words once, with their number.
    near = near.groupBy(F.xxhash64("entities", "words").alias("p1"), F.xxhash64("entities", "words", F.lit(1)).alias("p2")).agg(
        F.count("*").alias("w"), F.first("entities").alias("entities"), F.first("words").alias("words")
    )
    near = cut_lineage(near, "disclosure-passages")
    each = near.select("w", F.explode("entities").alias("entity"), "words")
    of_entity = each.groupBy("entity").agg(F.sum("w").alias("n_entity"))
    kinds = near.select("w", F.explode(F.array_distinct(F.transform("entities", lambda e: F.substring_index(e, ":", 1)))).alias("of")).groupBy("of").agg(F.sum("w").alias("n_kind"))
    both = each.select("w", "entity", F.explode("words").alias("term")).groupBy("entity", "term").agg(F.sum("w").alias("n_both"), F.count("*").alias("support"))
    both = cut_lineage(both.filter(F.col("support") >= SUPPORT), "disclosure-pairs")
    passages = _passages(texts)
    # Words are counted before they are joined: a task sends each word once.
    of_term = passages.select(F.explode(_words(F.col("tokens"))).alias("term")).groupBy("term").agg(F.count("*").alias("n_term"))
    of_term = cut_lineage(of_term.join(both.select("term").distinct(), "term", "left_semi"), "disclosure-terms")
    told = both.join(of_term, "term").join(of_entity, "entity").withColumn("of", F.substring_index("entity", ":", 1)).join(F.broadcast(kinds), "of")
    product = lambda a, b: F.col(a).cast("decimal(19,0)") * F.col(b).cast("decimal(19,0)")
    return told.filter(product("n_both", "n_kind") > product("n_entity", "n_term")).select(
        "entity", "term", F.when(2 * F.col("n_both") >= F.col("n_term"), "term").otherwise("hint").alias("kind"), "n_both", "n_term", "n_entity", "n_kind"
    )


def term_spans(texts: DataFrame, base: DataFrame, told: DataFrame) -> DataFrame:
    """(h1, h2, kind, start, end): occurrences of revealing terms in texts that hold the entity; terms win over hints."""
    wanted = base.select("h1", "h2", "entity").distinct().join(told.select("entity", "term", "kind"), "entity")
    wanted = cut_lineage(wanted.groupBy("h1", "h2", "term").agg(F.max("kind").alias("as")), "disclosure-wanted")  # "term" > "hint"
    rows = texts.filter(_any_gate(F.col("text"))).join(wanted.select("h1", "h2").distinct(), ["h1", "h2"], "left_semi").withColumn("kind", F.lit("token"))
    placed = _located(rows, F.split("text", TOKEN, -1), F.regexp_extract_all("text", F.lit(TOKEN), F.lit(0))).filter(_is_word(F.col("value")) & ~F.contains("value", F.lit("@")))
    hits = placed.select("h1", "h2", F.lower("value").alias("term"), "start", "end").join(wanted, ["h1", "h2", "term"])
    taken = base.select(F.col("h1").alias("x"), F.col("h2").alias("y"), F.col("start").alias("from"), F.col("end").alias("to"))
    meets = (F.col("h1") == F.col("x")) & (F.col("h2") == F.col("y")) & (F.col("start") < F.col("to")) & (F.col("from") < F.col("end"))
    return hits.join(taken, meets, "left_anti").select("h1", "h2", F.col("as").alias("kind"), "start", "end")


def _joined(kinds: tuple[str, ...]) -> Column:
    """The spans of these kinds as ``kind:start:end``, by start, then kind as listed."""
    own = F.filter("spans", lambda s: s["rank"] < len(kinds))
    name = lambda s: F.get(F.array(*(F.lit(k) for k in kinds)), s["rank"])
    return F.array_join(F.transform(own, lambda s: F.concat_ws(":", name(s), s["start"], s["end"])), ",")


def find_personal_data(documents: DataFrame) -> DataFrame:
    """(doc_id, text, spans): every row with its spans (start, rank of the kind in KINDS, end) in order."""
    texts = _texts(documents)
    base = cut_lineage(base_spans(texts), "disclosure-base")
    added = term_spans(texts, base, cut_lineage(revealing_terms(texts), "disclosure-told"))
    rank = F.array_position(F.array(*(F.lit(k) for k in KINDS)), F.col("kind")).cast("int") - 1
    each = base.drop("entity").unionByName(added).withColumn("rank", rank)
    spans = cut_lineage(each.groupBy("h1", "h2").agg(F.array_sort(F.collect_list(F.struct("start", "rank", "end"))).alias("spans")), "disclosure-spans")
    return texts.join(spans, ["h1", "h2"], "left").select("doc_id", "text", F.coalesce("spans", F.array().cast(spans.schema["spans"].dataType)).alias("spans"))


def sanitised(found: DataFrame) -> DataFrame:
    """(doc_id, text): base spans and hints give way to their kind in brackets, revealing terms to nothing but the brackets."""
    names = F.array(*(F.lit("[]" if k == "term" else f"[{k}]") for k in KINDS))
    ends = F.transform("spans", lambda s: s["end"])
    # Spans of different kinds may overlap: text goes on after the furthest end so far.
    reach = lambda k: F.greatest(F.lit(0), F.array_max(F.slice(ends, 1, k)))
    piece = lambda s, k: F.when(F.greatest(F.lit(0), reach(k)) <= s["start"], F.concat(F.substring("text", (reach(k) + 1).cast("int"), (s["start"] - reach(k)).cast("int")), F.get(names, s["rank"]))).otherwise("")
    last = F.substring("text", (reach(F.size("spans")) + 1).cast("int"), F.length("text"))
    return found.select("doc_id", F.when(F.size("spans") == 0, F.col("text")).otherwise(F.concat(F.array_join(F.transform("spans", piece), ""), last)).alias("text"))


# The same in SQL, with patterns of the plain kind. Copies are located each for itself.
_SQL_EMAIL = r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+"
_SQL_IP = r"[0-9]+\.[0-9]+\.[0-9]+\.[0-9]+"
_SQL_PATTERNS = {"email": _SQL_EMAIL, "ip": _SQL_IP, "card": "[0-9](?:[ -]?[0-9])+", "phone": PHONE}
_SQL_TOKEN = rf"{_SQL_EMAIL}|{_SQL_IP}|[0-9](?:[ -]?[0-9]){{11,}}|{PHONE}|\p{{L}}+"


def _sql() -> str:
    digits = lambda x: f"regexp_replace({x}, '[^0-9]', '', 'g')"
    part = lambda x, k: f"coalesce(try_cast(split_part({x}, '.', {k}) as hugeint) <= 255, false)"
    luhn = lambda x: (
        f"(length({digits(x)}) between 12 and 19 and list_sum([case when k % 2 = 1 then d when d > 4 then 2 * d - 9 else 2 * d end "
        f"for d, k in list_transform(string_split(reverse({digits(x)}), ''), lambda c: try_cast(c as int))]) % 10 = 0)"
    )
    valid = {
        "email": lambda x: "true",
        "ip": lambda x: " and ".join(part(x, k) for k in (1, 2, 3, 4)),
        "card": luhn,
        "phone": lambda x: f"length({digits(x)}) between 9 and 15",
    }
    entity = {"email": lambda x: f"'email:' || lower({x})", "ip": lambda x: f"'ip:' || {x}"} | {k: (lambda x, k=k: f"'{k}:' || {digits(x)}") for k in ("card", "phone")}
    located = lambda kind, rank, pattern: (
        f"select rid, '{kind}' as kind, {rank} as rank, matches[i] as value, "
        "(list_sum(list_transform(pieces[1:i], lambda p: length(p))) + coalesce(list_sum(list_transform(matches[1:i - 1], lambda m: length(m))), 0))::bigint as s "
        f"from (select *, unnest(range(1, len(matches) + 1)) as i from (select rid, string_split_regex(text, '{pattern}') as pieces, regexp_extract_all(text, '{pattern}') as matches from texts))"
    )
    named = lambda kind: f"select rid, kind, rank, {entity[kind]('value')} as entity, s, s + length(value) as e from (select * from of_{kind}) where {valid[kind]('value')}"
    of = ", ".join(f"of_{k} as ({located(k, n, p)})" for n, (k, p) in enumerate(_SQL_PATTERNS.items()))
    which = lambda t: f"case when contains({t}, '@') then 'email' when starts_with({t}, '+') then 'phone' when contains({t}, '.') then 'ip' when regexp_matches({t}, '^\\p{{L}}') then '' else 'card' end"
    return rf"""
with texts as (
    select row_number() over () as rid, doc_id, coalesce(text, '') as text from documents
), {of}, base as (
    {" union all ".join(named(k) for k in BASE)}
), passages as (
    select row_number() over () as pid, tokens[k + 1:k + {PASSAGE}] as tokens
    from (select tokens, unnest(range(0, len(tokens), {PASSAGE})) as k from (select regexp_extract_all(text, '{_SQL_TOKEN}') as tokens from texts))
), each_token as (
    select pid, t, {which("t")} as kind from (select pid, unnest(tokens) as t from passages)
), words as (
    select distinct pid, lower(t) as term from each_token where kind = ''
), told_in as (
    select distinct pid, entity from (
        {" union all ".join(f"select pid, {entity[k]('t')} as entity from each_token where kind = '{k}' and {valid[k]('t')}" for k in BASE)}
    )
), alike as (
    select p.pid, min(p.pid) over (partition by e.all_entities, w.all_words) as same
    from passages p join (select pid, list(entity order by entity) as all_entities from told_in group by pid) e using (pid)
    left join (select pid, list(term order by term) as all_words from words group by pid) w using (pid)
), n_term as (
    select term, count(*) as n_term from words group by term
), n_entity as (
    select entity, count(*) as n_entity from told_in group by entity
), n_kind as (
    select split_part(entity, ':', 1) as g, count(distinct pid) as n_kind from told_in group by 1
), n_both as (
    select entity, term, count(*) as n_both from told_in join words using (pid) join alike using (pid) group by all having count(distinct same) >= {SUPPORT}
), told as (
    select entity, term, case when 2 * n_both >= n_term then 4 else 5 end as rank
    from n_both join n_term using (term) join n_entity using (entity) join n_kind on g = split_part(entity, ':', 1)
    where n_both::hugeint * n_kind > n_entity::hugeint * n_term
), wanted as (
    select rid, term, min(rank) as rank from (select distinct rid, entity from base) join told using (entity) group by all
), of_word as (
    {located("word", 9, _SQL_TOKEN)}
), added as (
    select o.rid, w.rank, o.s, o.s + length(o.value) as e from of_word o join wanted w on o.rid = w.rid and lower(o.value) = w.term
    where regexp_matches(o.value, '^\p{{L}}') and not contains(o.value, '@')
      and not exists (select 1 from base b where b.rid = o.rid and b.s < o.s + length(o.value) and o.s < b.e)
), spans as (
    select rid, rank, s, e from base union all select rid, rank, s, e from added
), listed as (
    select rid, count(*) filter (rank = 0) as n_email, count(*) filter (rank = 1) as n_ip, count(*) filter (rank = 2) as n_card, count(*) filter (rank = 3) as n_phone,
           string_agg(name, ',' order by s, rank, e) filter (rank < 4) as base, string_agg(name, ',' order by s, rank, e) as spans
    from (select *, ['email', 'ip', 'card', 'phone', 'term', 'hint'][rank + 1] || ':' || s || ':' || e as name from spans) group by rid
)
select doc_id, coalesce(n_email, 0) as n_email, coalesce(n_ip, 0) as n_ip, coalesce(n_card, 0) as n_card, coalesce(n_phone, 0) as n_phone,
       sha256(coalesce(base, '')) as base_sha256, coalesce(spans, '') as spans
from texts left join listed using (rid)
"""


SQL = _sql()


@registered("op13_disclosure", SQL)
def op13_disclosure(spark: SparkSession, folder: str) -> DataFrame:
    found = find_personal_data(read(spark, folder, "documents"))
    count = lambda k: F.size(F.filter("spans", lambda s: s["rank"] == k)).cast("long")
    return found.select("doc_id", *(count(k).alias(f"n_{kind}") for k, kind in enumerate(BASE)), F.sha2(_joined(BASE), 256).alias("base_sha256"), _joined(KINDS).alias("spans"))

"""Operators on texts against plain Python."""

import hashlib
import math
import re
import tracemalloc
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from panelworks.llm import components, kneser_ney, quality_rules, signature_tree, suffix_dedup, token_orc, window_packing
from panelworks.llm.decontamination import SQL, find_leaks, without_leaks
from panelworks.llm.hyper_language import in_known_language, learn, predict
from panelworks.llm.line_windows import remove_repeated_lines, without_repeated_lines
from panelworks.scale import scratch_path

WORD = re.compile(r"[^\x20\x09-\x0D]+")
FOLD = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def test_lines_against_plain_python(documents, corpus):
    rows = sorted({r for r in corpus if r[0] is not None}, key=lambda r: r[0])
    first, gone = {}, defaultdict(set)
    for doc_id, text, *_ in rows:
        filled = [(i, line.strip(" \t\x0b\x0c\r")) for i, line in enumerate((text or "").split("\n")) if WORD.search(line)]
        for k in range(len(filled) - 2):
            if first.setdefault(tuple(line for _, line in filled[k : k + 3]), (doc_id, k)) < (doc_id, k):
                gone[doc_id].update(i for i, _ in filled[k : k + 3])
    found = {r["doc_id"]: r for r in remove_repeated_lines(documents).collect()}
    assert len(found) == len(rows) + 1
    for doc_id, text, *_ in rows:
        kept = None if text is None else "\n".join(line for i, line in enumerate(text.split("\n")) if i not in gone[doc_id])
        assert (found[doc_id]["text"], found[doc_id]["n_removed"]) == (kept, len(gone[doc_id]))
    assert found[None]["n_removed"] == 0
    assert any(gone.values())


def test_lines_keep_extra_columns_and_empty_tables(documents, nothing):
    wide = documents.select("*", F.lit(1).alias("w"), F.lit("x").alias("place"), F.lit(8).alias("n_lines"), F.array(F.lit(2)).alias("lines"))
    assert without_repeated_lines(wide).columns == wide.columns
    assert without_repeated_lines(wide).filter("w <> 1 or place <> 'x' or lines[0] <> 2").count() == 0
    assert without_repeated_lines(nothing).count() == 0


def test_language(documents, corpus, nothing):
    found = predict(documents, learn(documents), ("doc_id", "lang")).collect()
    assert len(found) == len(corpus)
    und = {r["doc_id"] for r in found if r["lang_pred"] == "und"}
    assert und == {50, 51, 52, 53}
    assert all(0 <= r["score"] <= 1 for r in found)
    assert all(r["lang_pred"] == r["lang"] for r in found if r["lang"] and r["doc_id"] not in und | {40, 44, 45, 54, 55, 56, 58})  # copies of a text in the other language, and texts of no language
    assert predict(documents, {}).filter("lang_pred <> 'und' or score <> 0").count() == 0
    assert predict(nothing, learn(nothing)).count() == 0
    kept = in_known_language(documents.withColumn("score", F.lit(5)).withColumn("lang_pred", F.lit("?")))
    assert "score" in kept.columns and kept.filter("doc_id in (50, 51, 52, 53)").count() == 0


def _encoded(corpus, name):
    model = Tokenizer.from_file(public_tokenizers.path(name))
    return [(r[0], [*model.encode(r[1] or "", add_special_tokens=False).ids, 2]) for r in corpus]


def _crc(ids):
    return zlib.crc32(b"".join(i.to_bytes(4, "little") for i in ids))


def test_tokens_round_trip(spark, documents, corpus, nothing):
    path = scratch_path(spark, "test-tokens")
    token_orc.write_tokens(documents.withColumn("part", F.lit("clash")), path, public_tokenizers.path("byte_bpe_50k.json"))
    tokens = token_orc.read_tokens(spark, path)
    want = sorted(_encoded(corpus, "byte_bpe_50k.json"), key=lambda r: (r[0] is not None, r[0] or 0))
    assert Counter((r["doc_id"], tuple(r["ids"])) for r in tokens.collect()) == Counter((d, tuple(i)) for d, i in want)
    starts = {r["part"]: r["before"] for r in token_orc.part_starts(tokens).collect()}
    rows = sorted((starts[r["part"]] + r["part_start"], r["n_tokens"], r["doc_id"], r["ids_crc32"]) for r in token_orc.digests(tokens).collect())
    at = 0
    for (start, n, doc_id, crc), (want_id, ids) in zip(rows, want, strict=True):
        assert (start, n, doc_id, crc) == (at, len(ids), want_id, _crc(ids))
        at += n
    assert token_orc.read_tokens(spark, path, [3, 57]).count() == 3
    token_orc.write_tokens(nothing, empty := scratch_path(spark, "test-tokens"), public_tokenizers.path("byte_bpe_50k.json"))
    assert token_orc.digests(token_orc.read_tokens(spark, empty)).count() == 0


def test_packing_holds_every_id_once(documents, corpus, nothing):
    path = public_tokenizers.path("word_bpe_49k.json")
    pieces = window_packing.pack(documents.withColumn("length", F.lit(0)), path).collect()
    want = Counter((d, tuple(i)) for d, i in _encoded(corpus, "word_bpe_49k.json"))
    by_doc = defaultdict(list)
    for p in pieces:
        by_doc[p["doc_id"]].append(p)
    for (doc_id, ids), times in want.items():
        covered = Counter()
        for p in by_doc[doc_id]:
            assert p["doc_tokens"] == len(ids) and p["ids_crc32"] == _crc(ids[p["start"] : p["start"] + p["length"]])
            covered.update(range(p["start"], p["start"] + p["length"]))
        assert covered == Counter({i: times for i in range(len(ids))})
    windows = defaultdict(list)
    for p in pieces:
        windows[p["sequence_id"]].append((p["offset"], p["length"]))
    for parts in windows.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at and length > 0
            at += length
        assert at <= 4096 and at & (at - 1) == 0
    assert window_packing.pack(nothing, path).count() == 0


def test_byte_strings_against_plain_python(documents, corpus, nothing):
    rows = sorted({r for r in corpus if r[0] is not None}, key=lambda r: r[0])
    data = {r[0]: (r[1] or "").encode() for r in rows}
    first = {}
    for doc_id, body in data.items():
        for p in range(len(body) - 49):
            first.setdefault(body[p : p + 50], doc_id)
    found = {r["doc_id"]: r for r in suffix_dedup.remove_repeats(documents.withColumn("part", F.lit(1))).collect()}
    removed = 0
    for doc_id, body in data.items():
        gone = bytearray(len(body))
        for p in range(len(body) - 49):
            if first[body[p : p + 50]] < doc_id:
                gone[p : p + 50] = b"\1" * 50
        runs = sum(1 for i, g in enumerate(gone) if g and not (i and gone[i - 1]))
        kept = hashlib.sha256(bytes(b for b, g in zip(body, gone, strict=True) if not g)).hexdigest()
        assert tuple(found[doc_id]) == (doc_id, len(body), sum(gone), runs, kept)
        removed += sum(gone)
    assert removed and found[None]["n_removed"] == 0
    assert suffix_dedup.remove_repeats(nothing).count() == 0


def _shingles(text, words):
    found = WORD.findall((text or "").translate(FOLD))
    if not found:
        return frozenset()
    return frozenset(tuple(found[k : k + words]) for k in range(len(found) - words + 1)) or frozenset([tuple(found)])


def _smallest(corpus, words, percent):
    sets = [(r[0], _shingles(r[1], words)) for r in corpus]
    parent = list(range(len(sets)))

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a in range(len(sets)):
        for b in range(a):
            shared = len(sets[a][1] & sets[b][1])
            if shared and 100 * shared >= percent * (len(sets[a][1]) + len(sets[b][1]) - shared):
                parent[root(a)] = root(b)
    least = {}
    for k, (doc_id, _) in enumerate(sets):
        if doc_id is not None:
            least[root(k)] = min(least.get(root(k), doc_id), doc_id)
    return Counter((d, len(s), least.get(root(k)) if s else d) for k, (d, s) in enumerate(sets))


def test_join_against_all_pairs(documents, corpus, nothing, monkeypatch):
    for words, percent in ((3, 90), (5, 80)):
        rule = signature_tree.Rule(words, percent)
        found = Counter(map(tuple, signature_tree.join_components(documents.withColumn("node", F.lit("x")), rule).collect()))
        assert found == _smallest(corpus, words, percent)
    assert signature_tree.join_components(nothing).count() == 0
    kept = signature_tree.one_of_each(documents, signature_tree.Rule())
    assert kept.columns == documents.columns and kept.filter("doc_id in (40, 41, 42)").count() == 0


def test_join_of_a_large_family_goes_through_blocks(spark):
    rows = []
    for i in range(700):
        words = [f"w{k}" for k in range(120)]
        for step in range(i % 7):
            words[(i * 13 + step * 17) % 120] = f"x{i}-{step}"
        rows.append((i, " ".join(words), None, None, None))
    found = signature_tree.join_components(spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long"))
    assert Counter(map(tuple, found.collect())) == _smallest(rows, 3, 90)


def test_join_of_a_long_chain_of_shared_parts(spark):
    # Each text shares most of its words with the next one, too few for a link; here and there two are closer.
    rows, at = [], 0
    for i in range(420):
        at += 3 if i % 9 == 0 else 14
        rows.append((i, " ".join(f"w{k}" for k in range(at, at + 200)), None, None, None))
    table = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").repartition(6)
    found = Counter(map(tuple, signature_tree.join_components(table).collect()))
    assert found == _smallest(rows, 3, 90)
    assert 300 < len({r[2] for r in found}) < 420


def test_a_node_of_a_large_family_is_in_one_family_per_key(spark, monkeypatch):
    rows = [(i, " ".join(f"w{k}" for k in range(12 * i, 12 * i + 200)), None, None, None) for i in range(60)]
    table = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").repartition(6)
    written, cut = {}, signature_tree.cut_lineage
    monkeypatch.setattr(signature_tree, "BLOCK", 8)
    monkeypatch.setattr(signature_tree, "cut_lineage", lambda df, label: written.setdefault(label, cut(df, label)))
    rule = signature_tree.Rule()
    assert Counter(map(tuple, signature_tree.join_components(table).collect())) == _smallest(rows, 3, 90)
    keys = {}
    for r in rows:
        values, offsets = signature_tree.shingle_sets(pa.record_batch({"text": [r[1]]}), rule)
        keys[int(signature_tree.nodes_of(values, offsets).view(np.int64)[0])] = set(signature_tree.part_keys(values, offsets, rule)[1].tolist())
    least = {}
    for node in sorted(keys):
        for key in keys[node]:
            least.setdefault(key, []).append(node)
    wanted = {(node, held[0]) for held in least.values() if len(held) > 1 for node in held}
    assert {n for n, _ in wanted} == set(keys)
    assert sorted(tuple(r) for r in written["tree-groups"].select("node", "family").collect()) == sorted(wanted)


def test_common_shingles_do_not_make_families(spark, monkeypatch):
    # Unrelated texts around a passage that all of them hold; every tenth is a near copy of the one before it.
    rng, rows = np.random.default_rng(8), []
    passage = [f"p{k}" for k in range(30)]
    for i in range(420):
        own = rows[-1][1].split()[:70] if i % 10 == 9 else [f"w{x}" for x in rng.integers(0, 1 << 40, 70)]
        rows.append((i, " ".join([*own, f"n{i}", *passage]), None, None, None))
    written, cut = {}, signature_tree.cut_lineage
    monkeypatch.setattr(signature_tree, "cut_lineage", lambda df, label: written.setdefault(label, cut(df, label)))
    table = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").repartition(6)
    found = Counter(map(tuple, signature_tree.join_components(table).collect()))
    assert found == _smallest(rows, 3, 90)
    assert 370 < len({r[2] for r in found}) < 420
    assert max(r["count"] for r in written["tree-families"].groupBy("family").count().collect()) < 20


def test_a_large_family_that_meets_few_blocks_stays_whole(spark, monkeypatch):
    rows = [(i, " ".join(f"w{k}" for k in range(12 * i, 12 * i + 200)), None, None, None) for i in range(60)]
    table = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").repartition(6)
    written, cut = {}, signature_tree.cut_lineage
    monkeypatch.setattr(signature_tree, "BLOCK", 32)
    monkeypatch.setattr(signature_tree, "cut_lineage", lambda df, label: written.setdefault(label, cut(df, label)))
    assert Counter(map(tuple, signature_tree.join_components(table).collect())) == _smallest(rows, 3, 90)
    assert written["tree-held"].count() == 0 and written["tree-groups"].count() == len(rows)


def test_tokens_are_encoded_in_small_batches(spark, documents, tmp_path, monkeypatch):
    sizes, limited = [], token_orc.batch_bytes
    monkeypatch.setattr(token_orc, "batch_bytes", lambda session, size: sizes.append(size) or limited(session, 1))
    before = spark.conf.get("spark.sql.execution.arrow.maxBytesPerBatch")
    paths = [f"{tmp_path}/{k}" for k in "ab"]
    token_orc.write_tokens(documents, paths[0], public_tokenizers.path("byte_bpe_50k.json"))
    assert max(sizes) <= 8 << 20 and spark.conf.get("spark.sql.execution.arrow.maxBytesPerBatch") == before
    monkeypatch.undo()
    token_orc.write_tokens(documents, paths[1], public_tokenizers.path("byte_bpe_50k.json"))
    rows = [Counter((r["doc_id"], tuple(r["ids"])) for r in token_orc.read_tokens(spark, p).collect()) for p in paths]
    assert rows[0] == rows[1] and rows[0].total() == documents.count()


def test_language_model(spark, documents, corpus, nothing):
    texts = documents.select("text")
    model = kneser_ney.train(texts)
    rows = kneser_ney.score(documents.withColumn("score", F.lit(0)).withColumn("token", F.lit(1)), model).collect()
    tokens = [[*WORD.findall((r[1] or "").translate(FOLD)), None] for r in corpus]
    count = Counter(t for doc in tokens for t in doc)
    assert (model.tokens, model.vocabulary) == (sum(count.values()), len(count))
    pairs = Counter(p for doc in tokens for p in zip(["<s>", *doc[:-1]], doc, strict=True))
    follow = defaultdict(Counter)
    for (a, b), n in pairs.items():
        follow[a][b] = n
    before = Counter(b for _, b in pairs)
    d1, d2 = model.token_discounts, model.pair_discounts
    lower_mass = sum(d1[min(n, 3)] for n in before.values()) / len(pairs)

    def probability(a, b):
        low = max(before[b] - d1[min(before[b], 3)], 0) / len(pairs) + lower_mass / (len(count) + 1)
        if a not in follow:
            return low
        total = sum(follow[a].values())
        return max(pairs[a, b] - d2[min(pairs[a, b], 3)], 0) / total + sum(d2[min(n, 3)] for n in follow[a].values()) / total * low

    # Everything that can follow a context, and one unknown token, share a probability of one.
    for context in ("<s>", "the", "never met"):
        assert abs(sum(probability(context, b) for b in [*count, "unknown token"]) - 1) < 1e-9
    import math

    want = Counter()
    for r, doc in zip(corpus, tokens, strict=True):
        score = sum(math.log10(probability(a, b)) for a, b in zip(["<s>", *doc[:-1]], doc, strict=True))
        base = sum(math.log10((count[t] + 1) / (model.tokens + len(count) + 1)) for t in doc)
        want[r[0], len(doc), round(base, 6), round(score, 6)] += 1
    assert Counter((r["doc_id"], r["n_tokens"], round(r["base_score"], 6), round(r["score"], 6)) for r in rows) == want
    assert kneser_ney.score(nothing, model).count() == 0
    unlearned = kneser_ney.score(documents, kneser_ney.train(nothing.select("text"))).collect()
    assert all(r["n_known"] == 0 and abs(r["score"]) < 1e-9 for r in unlearned)


def test_quality_counts_and_limits(documents, corpus, nothing):
    found = {r["doc_id"]: r for r in quality_rules.judge(documents.withColumn("n_words", F.lit(-1))).collect()}
    for doc_id, text, *_ in corpus:
        text = text or ""
        words = WORD.findall(text)
        lines = [x for x in text.split("\n") if WORD.search(x)]
        windows = [tuple(words[k : k + 5]) for k in range(len(words) - 4)]
        often = Counter(windows)
        repeat = len({k + j for k, w in enumerate(windows) if often[w] > 1 for j in range(5)})
        want = (len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text), len(lines) - len(set(lines)), repeat, len(words) < 10 or 100 * repeat > 20 * len(words))
        r = found[doc_id]
        assert (r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"], r["base_failed"]) == want
        assert not (r["kept"] and r["base_failed"])
    assert sum(r["kept"] for r in found.values()) > 40
    assert quality_rules.judge(nothing).count() == 0


def _ratios(r):
    words, lines = max(r["n_words"], 1), max(r["n_lines"], 1)
    return {"symbol_ratio": r["n_symbols"] / words, "duplicate_line_ratio": r["n_dup_lines"] / lines, "repeat_ratio": r["n_repeat_words"] / words, "word_length": r["word_chars"] / words}


def _fences(rows):
    """Upper fence per ratio from logarithmic bins, and the number of documents."""
    out = {}
    for ratio, least in quality_rules.LEAST_DISTANCE.items():
        values = [_ratios(r)[ratio] for r in rows]
        bins = sorted(-(10**9) if v < quality_rules.SMALLEST else math.floor(math.log(v) / quality_rules.BIN_WIDTH) for v in values)

        def quantile(share):
            at = bins[max(0, math.ceil(share * len(bins)) - 1)]
            return 0.0 if at == -(10**9) else math.exp((at + 0.5) * quality_rules.BIN_WIDTH)

        low, high = quantile(0.25), quantile(0.75)
        out[ratio] = high + quality_rules.FENCE * max(high - low, least)
    return len(rows), out


def test_quality_limits_and_verdicts_against_plain_python(documents, corpus):
    judged = [r.asDict() for r in quality_rules.judge(documents).collect()]
    of = {(d, t): (lang, source) for d, t, lang, source, _ in corpus}
    groups = {r["doc_id"]: next(v for (d, _), v in of.items() if d == r["doc_id"]) for r in judged}
    full = [r for r in judged if r["n_words"]]
    blend = lambda n, own, coarser: {k: (n * own[k] + quality_rules.PRIOR * coarser[k]) / (n + quality_rules.PRIOR) for k in own}
    _, all_ = _fences(full)
    verdicts = Counter()
    for r in judged:
        lang, source = groups[r["doc_id"]]
        own = [x for x in full if groups[x["doc_id"]] == (lang, source)]
        if not own:
            continue
        limits = blend(*_fences(own), blend(*_fences([x for x in full if groups[x["doc_id"]][0] == lang]), all_))
        for ratio, limit in limits.items():
            assert math.isclose(r[f"{ratio}_limit"], limit, rel_tol=1e-9), (r, ratio)
        within = all(_ratios(r)[k] <= limits[k] for k in limits)
        assert r["kept"] == (within and not r["base_failed"])
        verdicts[r["base_failed"], r["kept"]] += 1
    assert verdicts[False, True] > 30 and verdicts[True, False]


def test_sketches_merge_to_the_sketch_of_all(documents):
    counts = quality_rules.text_counts(documents, ("lang", "source"))
    rows = lambda df: Counter((r["ratio"], r["bin"], r["n"]) for r in df.collect())
    assert rows(quality_rules.merged(quality_rules.sketches(counts, ["lang", "source"]), [])) == rows(quality_rules.sketches(counts, []))


def test_benchmark_items(spark, corpus):
    item = "where does the Northern wind go when it meets water over stone houses and shining people? It goes into the valley with them."
    items = spark.createDataFrame([(1, item), (2, None), (3, ""), (4, "too short"), (None, item)], "item_id long, text string")
    near = item.replace("shining", "shiny")
    rows = [(i, t, None, None, None) for i, t in enumerate(["lead in text " * 40 + item.upper().replace("É", "é") + " and more", near, item[: len(item) // 3], None, "", "It goes into the valley with them."])]
    documents = spark.createDataFrame([*rows, rows[0], (None, item, None, None, None)], "doc_id long, text string, lang string, source string, n_chars long")
    found = find_leaks(documents.withColumn("item_id", F.lit(9)), items).collect()
    assert sorted((r["doc_id"], r["item_id"]) for r in found) == [(0, 1), (0, 1), (1, 1)]
    kept = without_leaks(documents, items)
    assert kept.count() == 5
    # few leaking ids are sent to the texts, and no text is shuffled for them
    plan = kept._jdf.queryExecution().sparkPlan().toString()
    assert "BroadcastHashJoin" in plan and "SortMergeJoin" not in plan
    assert find_leaks(documents, items.limit(0)).count() == 0 and find_leaks(documents.limit(0), items).count() == 0


def test_leaks_spread_over_a_document_against_the_sql(spark):
    import duckdb

    words = lambda name, n: [f"{name}{k}" for k in range(n)]
    noise = lambda name, n=200: " ".join(words(name, n))
    question, answer, long = words("q", 30), words("a", 30), words("l", 400)
    items = [(1, " ".join(question) + ". " + " ".join(answer)), (2, " ".join(long)), (3, "two words"), (4, " ".join(question[:20] + words("z", 40)))]
    documents = [
        (10, " ".join([*question[:21], noise("x"), *answer[:21]])),
        (11, " ".join([*question[:21], noise("y"), *answer[:15]])),
        (12, " ".join(f"{' '.join(long[k : k + 16])} {noise(f'p{k}-', 150)}" for k in range(0, 400, 16))),
        (13, " ".join(f"{' '.join(long[k : k + 16])} {noise(f'r{k}-', 150)}" for k in range(0, 400, 20))),
        (14, "Two words"),
        (15, " ".join([*question, noise("s", 300), *answer])),
        (16, None),
    ]
    con = duckdb.connect()
    for name, rows, key in (("benchmark", items, "item_id"), ("documents", documents, "doc_id")):
        con.execute(f"create table {name} ({key} bigint, text varchar)")
        con.executemany(f"insert into {name} values (?, ?)", rows)
    want = sorted((d, i, round(q, 9), round(a, 9)) for d, i, q, a in con.execute(SQL).fetchall())
    table = spark.createDataFrame(documents, "doc_id long, text string")
    found = find_leaks(table, spark.createDataFrame(items, "item_id long, text string")).collect()
    assert sorted((r["doc_id"], r["item_id"], round(r["question_overlap"], 9), round(r["answer_overlap"], 9)) for r in found) == want
    assert {(d, i) for d, i, *_ in want} >= {(10, 1), (12, 2), (14, 3), (15, 1)}
    assert all(0 < r["score"] <= 1 + 1e-9 for r in found)
    assert min(r["score"] for r in found if r["doc_id"] == 10) < 0.5


def test_language_model_of_order_three(spark, documents, corpus, nothing, monkeypatch):
    import math

    tokens = [[*WORD.findall((r[1] or "").translate(FOLD)), None] for r in corpus]
    count = Counter(t for doc in tokens for t in doc)
    triples = Counter(t for doc in tokens for t in zip(["<s>", "<s>", *doc], ["<s>", *doc], doc))
    pairs = Counter((b, c) for _, b, c in triples)
    single = Counter(c for _, c in pairs)
    after = {2: defaultdict(list), 3: defaultdict(list)}
    for (a, b, c), n in triples.items():
        after[3][a, b].append(n)
    for (b, c), n in pairs.items():
        after[2][b].append(n)
    for share in (kneser_ney.HOT_SHARE, 1.0):  # nearly all contexts spread, and none
        find_hot = kneser_ney.hot_contexts
        with monkeypatch.context() as patch:
            patch.setattr(kneser_ney, "hot_contexts", lambda texts, share=share: find_hot(texts, share))
            model = kneser_ney.train(documents.select("text"), 3)
        d1, d2, d3 = model.token_discounts, model.pair_discounts, model.triple_discounts
        mass = sum(d1[min(n, 3)] for n in single.values()) / len(pairs)

        def mixed(n, follow, d, lower):
            return lower if not follow else (max(n - d[min(n, 3)], 0) + sum(d[min(k, 3)] for k in follow) * lower) / sum(follow)

        def probability(a, b, c):
            low = max(single[c] - d1[min(single[c], 3)], 0) / len(pairs) + mass / (len(count) + 1)
            return mixed(triples[a, b, c], after[3].get((a, b)), d3, mixed(pairs[b, c], after[2].get(b), d2, low))

        for a, b in (("<s>", "<s>"), ("where", "the"), next(k for k in after[3] if "<s>" not in k), ("never", "met")):
            assert abs(sum(probability(a, b, c) for c in [*count, "unknown token"]) - 1) < 1e-9
        want = Counter()
        for r, doc in zip(corpus, tokens, strict=True):
            want[r[0], len(doc), round(sum(math.log10(probability(a, b, c)) for a, b, c in zip(["<s>", "<s>", *doc], ["<s>", *doc], doc)), 6)] += 1
        assert Counter((r["doc_id"], r["n_tokens"], round(r["score"], 6)) for r in kneser_ney.score(documents, model).collect()) == want
    unlearned = kneser_ney.score(documents, kneser_ney.train(nothing.select("text"), 3)).collect()
    assert all(r["n_known"] == 0 and abs(r["score"]) < 1e-9 for r in unlearned)


@pytest.mark.parametrize("percent", [80, 90])
@pytest.mark.parametrize("sizes", [range(30, 300, 3), range(300, 2000, 25), range(2000, 20_000, 300)])
def test_unrelated_sets_share_no_part_key(percent, sizes):
    sizes = np.array(sizes)
    values = np.random.default_rng(3).integers(1, 1 << 63, int(sizes.sum()), dtype=np.uint64)
    sets, keys = signature_tree.part_keys(values, np.append(0, np.cumsum(sizes)), signature_tree.Rule(3, percent))
    shared = Counter(key for _, key in set(zip(sets.tolist(), keys.tolist(), strict=True)))
    assert max(shared.values()) == 1


def test_linked_sets_share_a_part_key():
    rng = np.random.default_rng(4)
    for percent in (80, 90):
        rule = signature_tree.Rule(3, percent)
        for n in (1, 2, 3, 5, 9, 20, 60, 200, 1000, 5000):
            one = np.unique(rng.integers(1, 1 << 63, n, dtype=np.uint64))
            for share in (0.0, 0.5, 1.0):
                # As far apart as a link allows, by dropping, adding, or both.
                apart = int(share * rule.differences(np.array([n]))[0])
                two = np.unique(np.concatenate([one[apart // 2 :], rng.integers(1, 1 << 63, apart - apart // 2, dtype=np.uint64)]))
                if not signature_tree._linked(one, two, rule):
                    continue
                sets, keys = signature_tree.part_keys(np.concatenate([one, two]), np.array([0, len(one), len(one) + len(two)]), rule)
                assert len(one) == len(two) == apart == 0 or set(keys[sets == 0]) & set(keys[sets == 1]) or (len(one) == len(two) and (one == two).all())


def test_linked_sets_share_a_part_key_without_common_shingles():
    rng = np.random.default_rng(9)
    for percent in (80, 90):
        rule = signature_tree.Rule(3, percent)
        for n in (5, 9, 20, 60, 200, 1000):
            for common in (0.1, 0.5, 0.9, 1.0):
                one = np.unique(rng.integers(1, 1 << 63, n, dtype=np.uint64))
                apart = int(rule.differences(np.array([n]))[0])
                two = np.unique(np.concatenate([one[apart // 2 :], rng.integers(1, 1 << 63, apart - apart // 2, dtype=np.uint64)]))
                grades = np.zeros(1 << signature_tree.COUNTER_BITS, dtype=np.uint8)
                some = np.concatenate([one, two])
                some = some[rng.random(len(some)) < common]
                grades[signature_tree._counter(some)] = rng.integers(1, 6, len(some))
                if not signature_tree._linked(one, two, rule) or np.array_equal(one, two):
                    continue
                # Each in a batch of its own, as in tasks.
                keys = [set(signature_tree.part_keys(x, np.array([0, len(x)]), rule, grades)[1].tolist()) for x in (one, two)]
                assert keys[0] & keys[1]


def test_components_against_plain_python(spark, monkeypatch):
    rng = np.random.default_rng(5)
    links = [(int(a), int(b)) for a, b in rng.integers(-300, 300, (260, 2))] + [(k, k + 1) for k in range(1000, 1400)] + [(5000, k) for k in range(5001, 5200)]
    parent = {x: x for p in links for x in p}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in links:
        p, q = root(a), root(b)
        parent[max(p, q)] = min(p, q)
    want = {x: root(x) for p in links if p[0] != p[1] for x in p}
    table = spark.createDataFrame([*links, *links[:50], (None, 3), (3, None)], "a long, b long").repartition(7)
    for most in (1_000_000, 10):
        monkeypatch.setattr(components, "ONE_TASK", most)
        found = [tuple(r) for r in components.components(table).collect()]
        assert len(found) == len(want) and dict(found) == want
    assert components.components(table.limit(0)).count() == 0


def test_anchors_of_long_texts_in_steps(monkeypatch):
    rng = np.random.default_rng(6)
    sizes = [30, 40_000, 0, 49, 50, 9_000, 200]
    data = rng.integers(97, 101, sum(sizes)).astype(np.uint8)
    data[500:900] = 97  # ties
    offsets = np.concatenate([[0], np.cumsum(sizes)])
    whole = suffix_dedup._anchors(data, offsets)
    monkeypatch.setattr(suffix_dedup, "STEP_BYTES", 700)
    for one, two in zip(whole, suffix_dedup.anchors(data, offsets), strict=True):
        assert one.tolist() == two.tolist()


def test_memory_of_anchors_of_a_long_text():
    data = np.random.default_rng(7).integers(97, 123, 20 << 20).astype(np.uint8)
    suffix_dedup.anchors(data[: 1 << 20], np.array([0, 1 << 20]))
    tracemalloc.start()
    suffix_dedup.anchors(data, np.array([0, len(data)]))
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 8 * len(data)


def test_repeats_across_the_steps_of_a_long_text(spark):
    rng = np.random.default_rng(8)
    letters = np.frombuffer(b"abcdefgh ", np.uint8)
    long = letters[rng.integers(0, 9, 3 << 20)].tobytes().decode()
    passage = long[(1 << 18) - 100 : (1 << 18) + 150]
    rows = [(2, long), (1, "x" * 60 + passage), (3, long[: 1 << 20] + "end"), (4, None)]
    found = {r["doc_id"]: r for r in suffix_dedup.remove_repeats(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert (found[1]["n_removed"], found[2]["n_removed"], found[2]["n_spans"]) == (0, 250, 1)
    assert (found[3]["n_removed"], found[3]["n_spans"], found[4]["n_bytes"]) == (1 << 20, 1, 0)

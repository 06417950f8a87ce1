from __future__ import annotations

import random
import re
import zlib
from array import array
from collections import Counter

import numpy as np
import public_tokenizers as P
import pytest
from tokenizers import Tokenizer

import corpus_pipeline
from catchment.llm import fingerprints, packing, pii, quality, queries, toxicity
from catchment.llm.common import documents, join_groups

SF01, SF1 = "/root/testdata/sf0.01", "/root/testdata/sf0.1"


def held(doc_id):
    return zlib.crc32(str(doc_id).encode()) % 5 == 0


def auc(scores, labels):
    order = np.argsort(np.argsort(scores, kind="stable"), kind="stable") + 1.0
    scores, labels = np.asarray(scores), np.asarray(labels)
    for v in np.unique(scores):
        order[scores == v] = order[scores == v].mean()
    n1 = labels.sum()
    return (order[labels == 1].sum() - n1 * (n1 + 1) / 2) / (n1 * (len(labels) - n1))


@pytest.mark.parametrize(("name", "label", "least", "folder"), [("op5_toxicity", "toxic", 0.95, SF1), ("op10_quality", "quality", 0.95, SF01)])
def test_held_out_accuracy(spark, name, label, least, folder):
    got = queries.QUERIES[name](spark, folder).collect()
    assert len(got) == documents(spark, folder).count() and all(r.held_out == held(r.doc_id) and 0 <= r.score <= 1 for r in got)
    assert all(r.predicted == int(r.score >= (0.5 if label == "toxic" else 0.3)) for r in got)
    labels = {r.doc_id: r[label] for r in spark.read.parquet(f"{folder}/labels.parquet").collect()}
    pairs = [(r.score, labels[r.doc_id]) for r in got if r.held_out and r.doc_id in labels]
    assert auc(*zip(*pairs, strict=True)) > least


def test_models_do_not_learn_from_held_out_rows(spark):
    docs = documents(spark, SF01)
    labels = spark.read.parquet(f"{SF01}/labels.parquet")
    flipped = labels.selectExpr("doc_id", "IF(pmod(crc32(cast(cast(doc_id AS string) AS binary)), 5) = 0, 1 - quality, quality) AS quality", "toxic")
    a = {r.doc_id: r.score for r in quality.score(docs, labels).collect()}
    b = {r.doc_id: r.score for r in quality.score(docs, flipped).collect()}
    assert max(abs(a[k] - b[k]) for k in a) < 1e-9


@pytest.mark.parametrize("module", [quality, toxicity])
def test_models_on_odd_rows(spark, mixed, nothing, module):
    labels = spark.createDataFrame([(None, 1, 1), (3, None, None), (6, 0, 1), (6, 1, 0), (9, 5, 5)], "doc_id long, quality int, toxic int")
    for found in (labels, labels.limit(0)):
        got = module.score(mixed, found).collect()
        assert len(got) == mixed.count() and all(0 <= r.score <= 1 for r in got)
    assert module.score(nothing, labels).count() == 0


def test_isotonic():
    rng = np.random.default_rng(0)
    y = rng.random(50)
    c = rng.integers(1, 5, 50).astype(float)
    got = quality.isotonic(y * c, c)
    assert (np.diff(got) >= -1e-12).all() and got @ c == pytest.approx(y @ c)
    assert quality.isotonic(np.array([1.0, 2, 3]), np.ones(3)).tolist() == [1, 2, 3]


def test_grammar_scores_clauses():
    g = toxicity.Grammar({"zork*": 3.0})
    assert g.clause(["you", "idiot"]) > g.clause(["idiot"]) > g.clause(["not", "an", "idiot"]) > 0
    assert g.clause(["he", "said", "idiot"]) < g.clause(["he", "idiot"])
    assert g.clause(["zorkling"]) == 3.0 and g.clause(["nice", "day"]) == 0
    assert g.clause(["will", "kill", "you"]) > 0
    assert g.features("A nice day. You zorky idiot! Bye")[0] > g.features("A nice day. Bye")[0] == 0
    assert g.features("") == [0] * toxicity.FEATURES
    assert g.clause(["idiot", "you"]) == g.clause(["you", "idiot"])
    standing = lambda text: dict(zip(toxicity.STANDINGS, g.standings(text.split()), strict=False))
    assert standing("you idiot")["directed"] > 0 and standing("she said you idiot")["reported"] > 0
    assert standing("not an idiot")["negated"] > 0 and standing("what an idiot")["plain"] > 0


def test_fingerprints_by_hand(spark, mixed):
    keys = mixed.select("row", "text").distinct().withColumnRenamed("row", "k")
    whole = {r.k: (r.high, r.low) for r in fingerprints.simhash(keys, ["k"]).collect()}
    cut = {r.k: (r.high, r.low) for r in fingerprints.simhash(keys, ["k"], chunk=50).collect()}
    assert whole == cut and len(whole) == keys.count()
    texts = {r.k: r.text or "" for r in keys.collect()}
    by_text = {}
    for k, t in texts.items():
        assert by_text.setdefault(t, whole[k]) == whole[k]
    words = {t: t.lower().split() for t in list(texts.values())[:40]}
    terms = sorted({(a, b) for w in words.values() for a, b in (zip(w, w[1:], strict=False) if len(w) > 1 else [(x, "") for x in w])})
    frame = spark.createDataFrame(terms, "a string, b string").selectExpr("a", "b", "xxhash64(a, b) AS h0", "xxhash64(b, a, 1) AS h1")
    hashes = {(r.a, r.b): (r.h0 % (1 << 64)) << 64 | r.h1 % (1 << 64) for r in frame.collect()}
    for t, w in words.items():
        if not t.isascii():
            continue
        pairs = list(zip(w, w[1:], strict=False)) if len(w) > 1 else [(x, "") for x in w]
        weights = [min(4, 1 + (len(a) + len(b)) // 5) for a, b in pairs]
        want = sum(1 << i for i in range(128) if 2 * sum(x for p, x in zip(pairs, weights, strict=True) if hashes[p] >> i & 1) > sum(weights))
        high, low = by_text[t]
        assert (high % (1 << 64)) << 64 | low % (1 << 64) == want


def edited(rows):
    out = []
    for i, (d, t) in enumerate(rows):
        half = len(t) // 2
        out.append((d, len(t), t[: len(t) - half] + rows[(i + 1) % len(rows)][1][:half]))
    return out


def test_edited_pairs(spark, mixed, sf):
    import hashlib

    for docs in (mixed, documents(spark, sf)):
        rows = sorted(((r.doc_id, r.text or "") for r in docs.collect()))
        got = fingerprints.edited_pairs(docs).collect()
        want = Counter((d, n, hashlib.sha256(e.encode()).hexdigest()) for d, n, e in edited(rows))
        assert Counter((r.doc_id, r.n_chars, r.edited_sha256) for r in got) == want
    by = {r.doc_id: r for r in got}
    bits = lambda a, b: 1 - bin(int(a, 16) ^ int(b, 16)).count("1") / 128
    for i, (d, _) in enumerate(rows):
        assert by[d].near_edited == pytest.approx(bits(by[d].fingerprint, by[d].edited_fingerprint))
        assert by[d].near_next == pytest.approx(bits(by[d].fingerprint, by[rows[(i + 1) % len(rows)][0]].fingerprint))
    assert np.mean([r.near_edited > r.near_next for r in got]) > 0.95


def test_one_row_and_none(spark, nothing):
    one = spark.createDataFrame([(None, "a b c d")], "doc_id long, text string")
    r = fingerprints.edited_pairs(one).first()
    assert r.n_chars == 7 and r.fingerprint is not None
    assert fingerprints.edited_pairs(nothing).count() == 0


@pytest.mark.parametrize("radius", [1, 3, 7])
def test_block_tables_find_all_pairs(spark, radius):
    rng = random.Random(radius)
    base = [rng.getrandbits(128) for _ in range(15)]
    fps = list(dict.fromkeys(b ^ sum(1 << i for i in rng.sample(range(128), rng.randrange(0, 5))) for b in base for _ in range(6)))
    signed = lambda v: v - (1 << 64) if v >> 63 else v
    df = spark.createDataFrame([(i, signed(f >> 64), signed(f & (1 << 64) - 1)) for i, f in enumerate(fps)], "id long, high long, low long")
    want = {(i, j, d) for i in range(len(fps)) for j in range(i + 1, len(fps)) if (d := bin(fps[i] ^ fps[j]).count("1")) <= radius}
    assert {tuple(r) for r in fingerprints.within_radius(df, radius).collect()} == want


PERSONAL = [
    'write to ana.maria-7@mail.example.org or call +1 (415) 555-1234, card 4539578763621486, token = "0a1b2c3d4e5f60718293a4b5c6d7e8f9"',
    "Ana.Maria-7@mail.example.org again; +1 415 555 1234 again; host 10.0.255.7, ssn 123-45-6789",
    "Mr. John Smith met Frau Anna Krüger; Mr. John Smith left. Почта иван@почта.рф",
    None,
    "",
    "nothing here, 12 apples and 3.14",
    "4539-5787-6362-1486",
]


def test_surrogates(spark):
    docs = spark.createDataFrame([(i, t, 0, "x") for i, t in enumerate(PERSONAL)], "doc_id long, text string, n_chars long, entity string")
    out = {r.doc_id: r for r in pii.replace_entities(docs).collect()}
    assert pii.replace_entities(docs).columns == [*docs.columns, "n_entities"]
    for i in (3, 4, 5):
        assert out[i].text == PERSONAL[i] and out[i].n_entities == 0
    shape = lambda t: re.sub(r"\d", "9", t)
    for secret in ("ana.maria-7", "415) 555", "4539578763621486", "0a1b2c3d", "10.0.255.7", "123-45-6789", "John Smith", "Krüger", "иван", "4539-5787"):
        assert not any(secret in (r.text or "") for r in out.values()), secret
    assert out[0].n_entities == 4 and out[1].n_entities == 4 and out[2].n_entities == 4
    first = re.search(r"to (\S+) or call (\+1 \(\d{3}\) \d{3}-\d{4}), card (\d{16}), token = \"([0-9a-f]{32})\"", out[0].text)
    second = re.search(r"^(\S+) again; (\+1 \d{3} \d{3} \d{4}) again; host (\d\d\.\d\.\d{3}\.\d), ssn \d{3}-\d\d-\d{4}$", out[1].text)
    assert first and second and shape(first[2]) == "+9 (999) 999-9999"
    assert first[1].lower() == second[1].lower() and re.sub(r"\D", "", first[2]) == re.sub(r"\D", "", second[2])
    luhn = lambda d: sum(int(c) if i % 2 == 0 else sum(divmod(2 * int(c), 10)) for i, c in enumerate(reversed(d))) % 10
    assert luhn("4539578763621486") == 0 and luhn(first[3]) == 0 and out[6].text.replace("-", "") == first[3]
    men = re.findall(r"Mr\. (\w+ \w+)", out[2].text)
    assert men[0] == men[1] and men[0].split()[0] in pii.NAMES["m"].split()
    assert re.search(r"Frau (\w+) ", out[2].text)[1] in pii.NAMES["f"].split()
    assert re.search(r"[а-я]+@[а-я]+\.рф", out[2].text)
    assert all(r.n_chars == (None if r.text is None else len(r.text)) for r in out.values())


def test_surrogates_stay_distinct(spark):
    found = spark.createDataFrame([(f"Mr. A{chr(97 + i % 26)}{chr(97 + i // 26)} B{chr(97 + i % 26)}", 1) for i in range(300)] + [(f"9.9.9.{i}", 1) for i in range(10)], "entity string, n long")
    got = [r.replacement for r in pii.surrogates(found).collect()]
    assert len(got) == 310 and len(set(got)) == 310
    assert not {f"9.9.9.{i}" for i in range(10)} & set(got)


def test_op8_leaves_clean_documents_alone(spark, sf, mixed):
    texts = {r.doc_id: r.text for r in documents(spark, sf).collect()}
    got = queries.QUERIES["op8_pii"](spark, sf).collect()
    assert len(got) == len(texts)
    for r in got:
        assert (r.text == texts[r.doc_id]) == (r.n_entities == 0)
        assert not re.search(r"[\w.]+@mail\d\.example\.com", r.text)
    assert Counter(r.text for r in pii.replace_entities(mixed).collect()) == Counter(r.text for r in mixed.collect())


def test_join_groups_splits_hot_keys(spark):
    rows = spark.createDataFrame([("hot", i) for i in range(50)] + [(f"k{i}", i) for i in range(30)], "key string, v long")
    groups = rows.groupBy("key").count().withColumnRenamed("count", "n")
    assert join_groups(rows, groups, "key", "n", 80 * 500).count() == 80
    assert join_groups(rows, groups.filter("key <> 'k3'"), "key", "n", 1, "left").count() == 80


def shingle_set(text):
    w = (text or "").lower().split()
    return frozenset(" ".join(w[i : i + 5]) for i in range(max(1, len(w) - 4))) if w else frozenset()


def test_pipeline_stages_against_their_inputs(spark, sf):
    docs = documents(spark, sf)
    kept = {r.doc_id for r in quality.score(docs, spark.read.parquet(f"{sf}/labels.parquet")).filter("predicted = 1").select("doc_id").collect()}
    names = [n for n, _ in corpus_pipeline.STAGES]
    assert len(names) == 5
    one = corpus_pipeline.STAGES[0][1](spark, docs, sf)
    assert {r.doc_id for r in one.collect()} == kept and one.columns == docs.columns
    two = corpus_pipeline.STAGES[1][1](spark, one, sf)
    by_text = {}
    for r in one.collect():
        by_text[r.text] = max(by_text.get(r.text, -1), r.doc_id)
    assert {r.doc_id for r in two.collect()} == set(by_text.values()) and two.columns == docs.columns
    three = corpus_pipeline.STAGES[2][1](spark, two, sf)
    four = corpus_pipeline.STAGES[3][1](spark, three, sf)
    assert four.columns == docs.columns and {r.doc_id for r in four.collect()} == {r.doc_id for r in three.collect()}
    rows = corpus_pipeline.run(spark, sf).collect()
    assert {r.doc_id for r in rows} == {r.doc_id for r in three.collect()}
    # Near copies by all pairs, chained.
    sets = {r.doc_id: shingle_set(r.text) for r in two.collect()}
    root = {i: i for i in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i, a in sets.items():
        for j, b in sets.items():
            if i < j and (a == b or len(a & b) >= 0.8 * len(a | b)):
                x, y = find(i), find(j)
                root[max(x, y)] = min(x, y)
    assert {r.doc_id for r in three.collect()} == {find(i) for i in sets}
    # Texts with what the patterns find replaced, and nothing else; pieces by the plain library.
    before, after = {r.doc_id: r.text for r in three.collect()}, {r.doc_id: r.text for r in four.collect()}
    counted = {r.doc_id: r.n_entities for r in pii.replace_entities(three).collect()}
    assert all((before[i] == after[i]) == (counted[i] == 0) for i in before)
    library = Tokenizer.from_file(P.path("byte_bpe_50k.json"))
    want = Counter()
    for i, text in after.items():
        ids = [*library.encode(text or "", add_special_tokens=False).ids, 2]
        first = (len(ids) - 1) % packing.CAPACITY + 1
        for k, a in enumerate([0, *range(first, len(ids), packing.CAPACITY)]):
            part = ids[a : first if k == 0 else a + packing.CAPACITY]
            want[i, k, a, len(part), zlib.crc32(array("I", part).tobytes())] += 1
    assert Counter((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in rows) == want
    used = Counter()
    for r in rows:
        used[r.sequence_id] += r.length
    assert max(used.values()) <= packing.CAPACITY

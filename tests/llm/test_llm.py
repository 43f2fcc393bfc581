import random
from itertools import combinations

import numpy as np
import pyarrow as pa
import pytest

pytest.importorskip("quotemill.llm")
from quotemill.llm import canonical_text, encoding_repair, leakage, listing_text, product_match, shared_spans, tokenize_corpus  # noqa: E402

DOCS = "doc_id long, text string, seed int, anchor int"


def docs(spark, texts):
    return spark.createDataFrame([(i, t, 0, 0) for i, t in enumerate(texts)], DOCS)


# p8


def shares(a, b, span):
    return any(a[i : i + span] in b for i in range(len(a) - span + 1))


def test_spans_equal_brute_force():
    rng = random.Random(1)
    for _ in range(20):
        base = "".join(rng.choice("abé") for _ in range(60))
        parts = []
        for _ in range(rng.randint(2, 10)):
            s, n = rng.randint(0, 40), rng.randint(5, 40)
            parts.append("".join(rng.choice("abé") for _ in range(rng.randint(0, 30))) + base[s : s + n])
        q, h, qo, ho, size = shared_spans.spans_of(parts, np.ones(len(parts), bool), 16)
        assert set(zip(q.tolist(), h.tolist())) == {(i, j) for i, a in enumerate(parts) for j, b in enumerate(parts) if i != j and shares(a, b, 16)}
        for i, j, a, b, n in zip(q, h, qo, ho, size):
            assert parts[i][a : a + n] == parts[j][b : b + n]


def test_shared_pairs_equal_brute_force(spark):
    rng = random.Random(2)
    words = ["".join(rng.choice("abcdeé ") for _ in range(7)) for _ in range(400)]
    text = lambda n: "".join(rng.choice(words) for _ in range(n))
    a = text(60)
    texts = [text(50) + a[:210], text(3) + a[5:205] + text(40), a[:199] + text(30), a, a, None, "", text(200), "x" * 450, "x" * 300, text(90) + "\r\n" + a[100:]]
    pairs = {tuple(r) for r in shared_spans.shared_pairs(docs(spark, texts)).collect()}
    want = {(i, j) for (i, x), (j, y) in combinations(enumerate(texts), 2) if x and y and len(x) >= 200 and len(y) >= 200 and shares(x, y, 200)}
    assert pairs == want
    share = {r["doc_id"]: (r["n_chars"], r["shared_chars"]) for r in shared_spans.shared_share(docs(spark, texts)).collect()}
    assert share[5] == (None, None) and share[6] == (0, 0) and share[3] == (len(a), len(a)) and share[7] == (1400, 0) and share[0][1] >= 200


# p7


def test_leaks_equal_brute_force(spark):
    rng = random.Random(3)
    w = lambda n: [rng.choice(["alpha", "Beta", "12", "é", "gamma", "delta"]) + str(rng.randint(0, 99)) for _ in range(n)]
    item = w(20)
    texts = [" ".join(w(5) + item[3:15] + w(5)), "-".join(x.upper() for x in item[:12]), " ".join(item[:11]), None, "", " ".join(w(4) + item[:5] + ["odd"] + item[6:14] + w(3))]
    items = spark.createDataFrame([(7, " ".join(item), "a"), (8, "too short", "a"), (9, None, "a")], "item_id long, text string, doc_id string")
    assert {tuple(r) for r in leakage.leaked_pairs(docs(spark, texts), items).collect()} == {(0, 7), (1, 7)}
    near = {r["doc_id"]: r["leaked_words"] for r in leakage.overlaps(docs(spark, texts), items).collect()}
    assert near[0] >= 12 and near[5] >= 12 and 2 not in near


# p6


@pytest.fixture(scope="module")
def encoder():
    return tokenize_corpus.Encoder(open(tokenize_corpus.vocabulary_path(), "rb").read())


def odd_text(rng, n):
    return "".join(rng.choice(["'s", "'re", "'", "r", "e", " ", "  ", "\n", "\t", "a", "bc", "é", "12", "!", "..", "中", " ", "’", "'ll", "\r\n", "😀", "1²", "<|endoftext|>", "\x1c", "x" * 300]) for _ in range(n))


def test_ids_equal_the_library(encoder):
    rng = random.Random(4)
    for _ in range(300):
        texts = [odd_text(rng, rng.randint(0, 12)) for _ in range(3)] + [None, ""]
        assert encoder.encode_column(pa.array(texts)).to_pylist() == [encoder.own.encode_ordinary(t or "") for t in texts]


def test_parts_join_exactly(encoder):
    rng = random.Random(5)
    for k in range(150):
        x = odd_text(rng, rng.randint(1, 12)) if k % 2 else "".join(rng.choice("ab") for _ in range(rng.randint(300, 3000)))
        n = rng.randint(1, 9) if len(x) < 200 else rng.randint(50, 900)
        parts = [encoder.part(x[i : i + n]) for i in range(0, len(x), n)]
        assert encoder.join_parts([encoder.part(p[0]) for p in parts])[3].tolist() == encoder.own.encode_ordinary(x)


def test_every_document_has_ids(spark, encoder):
    texts = ["a b", None, "", "word " * 50 + "y" * 400, "a b"]
    got = {r["doc_id"]: r["ids"] for r in tokenize_corpus.encode_documents(docs(spark, texts), part_chars=64).collect()}
    assert got == {i: encoder.own.encode_ordinary(t or "") for i, t in enumerate(texts)}


# p1, p4

CLEAN = ["Gehäuse geprüfte Größe", "Façade grade 90° bend", "Крон медный литой", "pièce d’usure où précisé", "ŻELIWNA PŁYTA", "kΩ 10–14 ½ ™", "NÃO PRESSÃO", "plain ascii text"]


@pytest.fixture(scope="module")
def items(spark):
    bad = ["GehÃ¤use geprÃ¼fte", "Fa├ºade grade", "ÊðîÌ ìåäíûé ëèòîé", "Gr��e lost", "d‚graiss‚e piŠce", "geh​äuse Gеhäusе", "Ｆａｃａｄｅ", "pièce", "ﬁne", "a b", "PΝ123 plain"]
    rows = [c for c in CLEAN for _ in range(40)] + bad
    return spark.createDataFrame([(i, t) for i, t in enumerate([*rows, None, ""])], "item_id long, description string"), rows


def test_garbled_and_lookalike_items(spark, items):
    df, rows = items
    garbled = {rows[r[0]] for r in encoding_repair.garbled_items(df).collect()}
    alike = {rows[r[0]] for r in canonical_text.lookalike_items(df).collect()}
    assert {"GehÃ¤use geprÃ¼fte", "Fa├ºade grade", "Gr��e lost"} <= garbled and not garbled & set(CLEAN)
    assert {"geh​äuse Gеhäusе", "Ｆａｃａｄｅ", "pièce", "ﬁne", "a b", "PΝ123 plain"} == alike
    fixed = {r["item_id"]: r["restored"] for r in encoding_repair.repaired(df).collect()}
    assert fixed[rows.index("GehÃ¤use geprÃ¼fte")] == "Gehäuse geprüfte" and fixed[len(rows)] is None and fixed[len(rows) + 1] == ""


def test_canonical_form_joins_equal_looks():
    assert canonical_text.canonical("Ｆａ​ｃａｄｅ STRASSE") == canonical_text.canonical("facade straße")
    assert canonical_text.canonical("cоpper") == "copper" and canonical_text.canonical("кот") == "кот" and canonical_text.canonical("") == ""


# p2


def test_listings_taken_apart():
    s, code, words = listing_text.take_apart('Acme rod 2-1/4 x 1 x 20 incehs, Art. AC-1234567B')
    assert [round(x, 3) for x in s] == [508.0, 57.15, 25.4] and code == "AC1234567B" and words == ["acme", "rod"]
    assert listing_text.take_apart("L450 W 44 H=39 mm")[0] == [450.0, 44.0, 39.0] and listing_text.take_apart("no size")[0] == []


def test_same_product(spark):
    rng = random.Random(6)
    ads, rows, truth = ["new", "top rated", "free returns", "sale"], [], {}
    alike = {"acetal": ["acetal", "POM-C"], "brass": ["brass", "CuZn39 brass"], "zinc": ["zinc plated", "Zn plated"], "raw": ["raw finish", "uncoated"]}
    for p in range(160):
        brand, material, finish = rng.choice(["Acme", "Bolt", "Crow"]), rng.choice(["acetal", "brass"]), rng.choice(["zinc", "raw"])
        size = [rng.randint(10, 12), rng.randint(20, 21), rng.choice([200, 300])]
        key = (brand, material, finish, *size)
        code = f"{brand[:2].upper()}{p:07d}B"
        code = truth.setdefault(key, code)
        dims = f"{size[0]}x{size[1]}x{size[2]} mm" if rng.random() < 0.5 else f"{size[0] / 10} × {size[1] / 10} × {size[2] / 10} cm"
        words = [brand, rng.choice(alike[material]), rng.choice(alike[finish]), dims, rng.choice(ads)] + ([code] if rng.random() < 0.7 else [])
        rng.shuffle(words)
        rows.append((len(rows), ", ".join(words), key))
    rows += [(len(rows), rows[0][1], rows[0][2]), (len(rows) + 1, None, None), (len(rows) + 2, "", None)]
    df = spark.createDataFrame([(i, t, "x") for i, t, _ in rows], "listing_id long, description string, text_id string")
    got = {tuple(r) for r in product_match.same_product(df).collect()}
    want = {(a[0], b[0]) for a, b in combinations(rows, 2) if a[2] and a[2] == b[2]}
    assert len(got & want) >= 0.9 * len(want) and len(got - want) <= 0.05 * len(got)


def test_probes_reach_neighbours_without_a_code_in_any_cell():
    import numpy as np

    from quotemill.llm import product_match

    # two listings near each other, parted by 30 cells that are nearer to the first than the second's own
    middle = np.concatenate([np.array([[0.0, 0.0]]), np.stack([np.full(30, -0.1), np.linspace(-0.1, 0.1, 30)], 1), np.array([[0.9, 0.0]])]).astype(np.float32)
    points = np.array([[0.0, 0.0], [0.5, 0.0]], np.float32)
    assert product_match.tuned_probes(points, middle, radius=0.3) == 32


def test_planted_encodings_are_put_right(spark):
    clean = ["Gehäuse geprüfte Größe", "Façade grade plate", "Крон медный литой", "pièce détachée précisée", "Válvula de presión según muestra", "średnica żeliwna płyta"]
    pairs = [("utf-8", w) for w in encoding_repair.MULTI] + list(encoding_repair.SINGLE)
    rows, want = [c for c in clean for _ in range(60)], {}
    for written, read in pairs:
        for c in clean:
            try:
                garbled = encoding_repair.read_as(c.encode(written), read)
            except UnicodeEncodeError:
                continue
            if garbled != c:
                want[len(rows)] = c
                rows.append(garbled)
    rows += ["CANTONEIRA\xa0de", "class\xa02", "ﬁne ﬂange"]  # no garbled text
    df = spark.createDataFrame(list(enumerate(rows)), "item_id long, description string")
    got = {r["item_id"]: (r["restored"], r["garbled"]) for r in encoding_repair.repaired(df).collect()}
    exact = sum(got[i][0] == c for i, c in want.items())
    assert exact >= 0.95 * len(want), (exact, len(want))
    assert not any(got[i][1] for i in range(len(rows)) if i not in want)


def test_long_unsplit_text_is_encoded_exactly(spark, encoder):
    rng = random.Random(9)
    texts = ["".join(rng.choice("abc") for _ in range(400_000)), "word 's it " * 40_000]
    got = {r["doc_id"]: r["ids"] for r in tokenize_corpus.encode_documents(docs(spark, texts)).collect()}
    assert got == {i: list(encoder.concatenate(encoder.piece_ids(t.encode()[:200_000]), encoder.piece_ids(t.encode()[200_000:]))) if i == 0 else encoder.own.encode_ordinary(t) for i, t in enumerate(texts)}


def test_listings_without_sizes_and_hot_sizes(spark, monkeypatch):
    monkeypatch.setattr(product_match, "HOT", 3)
    monkeypatch.setattr(product_match, "FARTHER", 1e9)
    rows = [(i, f"Acme bolt {word} 10 x 20 x 30 mm AB1234567") for i, word in enumerate(["new", "sale", "top", "best", "fine", "good", "nice", "neat"])] + [(8, "Acme bracket 40 x 20 mm"), (9, "sale Acme bracket 40 x 20 mm"), (10, "sale Acme bracket 41 x 20 mm")]
    got = {tuple(r) for r in product_match.same_product(spark.createDataFrame(rows, "listing_id long, description string"), radius=1e9).collect()}
    assert {(a, b) for a in range(8) for b in range(a + 1, 8)} | {(8, 9)} == got

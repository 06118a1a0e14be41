from collections import defaultdict

import numpy as np

from gridloom.llm import leakage as L

NAMES = ["Rebo", "Takuni", "Mavelo", "Pirado", "Sunofe", "Galiko", "Vetari", "Domehu", "Kifola", "Zunera", "Bahido", "Lorepa"]
PATTERNS = [
    "If {0} doubles the dented rubber seals in the cellar, then {1} receives {2} more of them than {3} ever kept.",
    "Between {0} and {1} a cart with {2} glass beads loses nearly {3} of them on every single stony mile.",
    "A ledger from {0} lists {2} linen sacks and {1} counts {3} of the brass lamps that were sent there.",
]
STOCK = "Explain your reasoning step by step."
FILL = "The nightly export stops after roughly forty records and nothing useful shows up in the log of the server. "


def make(seed):
    rng = np.random.default_rng(seed)
    out = []
    for p in PATTERNS:
        name = lambda: NAMES[rng.integers(12)] + str(chr(97 + rng.integers(26))) + str(chr(97 + rng.integers(26)))
        a, b = name(), name()
        out.append(p.format(a, b, rng.integers(1000, 9999), rng.integers(1000, 9999)))
    return out


def test_index_has_every_position(spark):
    texts = [(1, "The cat, the CAT."), (2, None), (3, " "), (4, "c​at ５6"), (1, "cat")]
    got = L.positional_index(spark.createDataFrame(texts, "doc_id bigint, text string")).collect()
    want = defaultdict(list)
    for n, (d, t) in enumerate(texts):
        for k, w in enumerate(L.tokens(t)):
            want[n, d, w].append(k)
    assert sorted((r["term"], r["doc_id"], list(r["positions"])) for r in got) == sorted((w, d, p) for (_, d, w), p in want.items())
    assert L.tokens("Zähler c​at ５6") == ["zahler", "cat", "56"]


def test_stretches_allow_changes():
    item = list(range(30))
    doc = [99] * 50 + item[:8] + [77] + item[9:20] + [88] + item[21:30]
    i, j = zip(*[(a, b) for a, x in enumerate(item) for b, y in enumerate(doc) if x == y])
    best = max(L.stretches(np.array(i), np.array(j), np.ones(len(i), bool)), key=lambda s: s[2])
    assert best[:3] == (0, 29, 28)


def test_leaks_and_traps(spark):
    items = {k: make(k) for k in range(40)}
    rows = [(k, " ".join(s) + (" " + STOCK if k % 2 else "")) for k, s in items.items()]
    docs, want = [], set()

    def doc(text, *hits):
        docs.append((len(docs), text, "x"))
        want.update((len(docs) - 1, h) for h in hits)

    doc(FILL + rows[0][1] + FILL, 0)
    doc(FILL + "\n\n".join(reversed(items[1])).upper(), 1)  # other order and case
    doc("**" + items[2][0].replace(" ", "\n> ") + "** " + FILL, 2)  # one sentence in another layout
    words = rows[3][1].split()
    doc(FILL + " ".join(w for n, w in enumerate(words) if n % 11 != 5), 3)  # words left out
    doc(" ".join("else" if n % 10 == 4 else w for n, w in enumerate(rows[4][1].split())), 4)  # words changed
    doc("​".join(items[5][1]).replace("​ ​", " ") + FILL, 5)  # hidden signs
    doc(rows[6][1] + FILL * 300 + rows[7][1], 6, 7)
    for k in range(100, 160):
        doc(FILL + " ".join(make(k)))  # the items' style
    doc(FILL + STOCK)
    doc(FILL + " ".join(items[8][0].split()[:5]) + ". " + FILL)  # a quotation of a few words
    docs += [(900, None, "x"), (901, "", "x"), (902, " \n", "x"), (903, docs[0][1], "x"), (903, docs[0][1], "x")]
    want.add((903, 0))
    df = spark.createDataFrame(docs, "doc_id bigint, text string, term string")
    table = spark.createDataFrame([*rows, (500, None), (501, "")], "item_id bigint, text string")
    got = L.leaked_items(df, table).collect()
    assert {(r["doc_id"], r["item_id"]) for r in got} == want
    assert next(r for r in got if (r["doc_id"], r["item_id"]) == (0, 0))["exact"]
    assert L.leaked_items(df.limit(0), table).count() == 0
    assert L.leaked_items(df, table.limit(0)).count() == 0


def test_widely_leaked_items(spark):
    items = {k: make(k) for k in range(40)}
    rows = [(k, " ".join(s) + (" " + STOCK if k % 2 else "")) for k, s in items.items()]
    docs, want = [], set()

    def doc(text, *hits):
        docs.append((len(docs), text))
        want.update((len(docs) - 1, h) for h in hits)

    for _ in range(40):
        doc(FILL + rows[0][1], 0)  # copies
    doc(FILL + "Other words. " + items[0][1], 0)  # a part of the same, outside the copies
    for k in range(40):
        doc(f"Number {k} of many. " + FILL * (k % 3) + rows[1][1], 1)  # all different
    doc(FILL + rows[1][1].replace("linen", "woolen"), 1)
    doc(" ".join("else" if n % 4 == 3 else w for n, w in enumerate(rows[1][1].split())), 1)  # hardly any phrase is left
    doc(FILL + " ".join(items[1][0].split()[:6]) + ". " + FILL)  # a quotation of a few words
    for k in range(100, 140):
        doc(FILL + " ".join(make(k)))
        doc(FILL + STOCK)
    df = spark.createDataFrame(docs, "doc_id bigint, text string")
    got = L.leaked_items(df, spark.createDataFrame(rows, "item_id bigint, text string")).collect()
    assert {(r["doc_id"], r["item_id"]) for r in got} == want
    assert len(got) == len(want)


def test_stretches_of_common_words(spark):
    rng = np.random.default_rng(3)
    common = [a + b for a in ("ba", "de", "fi", "go", "lu", "ma") for b in ("n", "r", "st", "t", "x", "mp", "sk")]
    shuffled = lambda n: rng.permutation(common).tolist()[:n]
    items = [shuffled(15) for _ in range(4)]
    items[1][7] = "zyxo"
    items[2][4], items[2][10] = "wuvi", "qopa"
    changed = [w if w != "wuvi" else "else" for w in items[2]]
    gaps = [w if n % 3 else "else" for n, w in enumerate(items[3])]
    docs = [(n, " ".join([*shuffled(40), *stretch, *shuffled(40)])) for n, stretch in enumerate([items[0], items[1], items[2], changed, gaps, items[3][:9]])]
    docs += [(n, " ".join(shuffled(42) + shuffled(42))) for n in range(10, 70)]
    table = spark.createDataFrame([(n, " ".join(w)) for n, w in enumerate(items)], "item_id bigint, text string")
    got = L.leaked_items(spark.createDataFrame(docs, "doc_id bigint, text string"), table).collect()
    assert {(r["doc_id"], r["item_id"]) for r in got} == {(0, 0), (1, 1), (2, 2), (3, 2)}


def test_pruning_is_exact():
    rng = np.random.default_rng(7)
    for n in (1, 5, 300):
        i, j = rng.integers(0, 30, n), rng.integers(0, 80, n)
        anchor = rng.random(n) < 0.3
        near = ((np.abs(j[:, None] - j[anchor][None, :]) <= 3 * L.DRIFT) & (np.abs((j - i)[:, None] - (j - i)[anchor][None, :]) <= L.DRIFT)).any(axis=1)
        assert (L._near(i, j, i[anchor], j[anchor]) == near).all()
        di, dj = i[:, None] - i[None, :], j[:, None] - j[None, :]
        steps = ((di >= 1) & (di <= L.DRIFT) & (dj >= 1) & (dj <= L.DRIFT)) | ((di <= -1) & (di >= -L.DRIFT) & (dj <= -1) & (dj >= -L.DRIFT))
        assert (L._linked(i, j) == steps.any(axis=1)).all()
    assert L.longest_run(np.array([0, 1, 2, 7, 8, 3]), np.array([10, 11, 12, 17, 18, 99])) == 3
    assert L.longest_run(np.array([4]), np.array([4])) == 1


def test_items_of_common_words_repeated_items_and_hot_words(spark):
    rng = np.random.default_rng(1)
    vocabulary = [f"w{k}x" for k in range(500)]
    items = [(k, " ".join(rng.choice(vocabulary, 20))) for k in range(40)]
    items += [(k, items[7][1].upper()) for k in (40, 41, 42, 43, 44, 45)]  # one item seven times
    docs = []
    for k in range(200):
        w = list(rng.choice(vocabulary, 300))
        if k < 3:
            w[100:100] = items[0][1].split()
        if k in (5, 6):
            w[50:50] = items[7][1].split()
        docs.append((k, " ".join(w)))
    hot = items[1][1].split()[4]
    docs.append((500, f"{hot} " * 20_000 + items[1][1]))
    got = L.leaked_items(spark.createDataFrame(docs, "doc_id bigint, text string"), spark.createDataFrame(items, "item_id bigint, text string")).collect()
    want = {(0, 0), (1, 0), (2, 0), (500, 1)} | {(d, k) for d in (5, 6) for k in (7, 40, 41, 42, 43, 44, 45)}
    assert {(r["doc_id"], r["item_id"]) for r in got} == want and len(got) == len(want)
    assert all(r["run"] == 20 and r["exact"] for r in got if r["doc_id"] != 500)


def test_queries_equal_their_sql(spark):
    import os

    import duckdb

    from gridloom.llm import queries

    folder = "/root/testdata/sf0.001"
    if not os.path.isdir(folder):
        return
    con = duckdb.connect()
    for f in os.listdir(folder):
        con.execute(f"CREATE VIEW {f.removesuffix('.parquet')} AS SELECT * FROM '{folder}/{f}'")
    for name in ("p6_packing_faults", "p7_exact_phrases", "p8_label_codes", "p8_segment_faults"):
        df = queries.QUERIES[name](spark, folder)
        columns = ", ".join(sorted(df.columns))
        assert sorted(map(tuple, df.select(sorted(df.columns)).collect()), key=str) == sorted(con.execute(f"SELECT {columns} FROM ({queries.ORACLES[name]})").fetchall(), key=str), name

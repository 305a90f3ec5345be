import hashlib
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest

from quillmark.llm import queries, secret_scan, spelling, whitening

# --- whitening ------------------------------------------------------------------------------------


def exact(vectors, wanted=4):
    x = np.floor(256 * np.array(vectors, dtype=float)).astype(np.int64)
    fit = np.unique(x, axis=0)
    n, s = len(fit), fit.sum(axis=0)
    v = (fit - s / n).T @ (fit - s / n) / n
    values, axes = np.linalg.eigh(v)
    values, axes = values[::-1][:wanted], axes[:, ::-1][:, :wanted]
    return x, n, ((n * x - s) ** 2).sum(axis=1), values, axes, (x - s / n) @ axes, values / np.trace(v)


def check_white(rows, ids, vectors, wanted=4):
    x, n, deviation, values, _, projected, shares = exact(vectors, wanted)
    by = {(r["vec_id"], r["component"]): r for r in rows}
    assert len(rows) == len(ids) * min(wanted, x.shape[1])
    for k in range(min(wanted, x.shape[1])):
        ours = np.array([by[i, k + 1]["whitened"] for i in ids])
        want = projected[:, k] / np.sqrt(values[k])
        sign = np.sign(ours @ want)
        assert np.abs(ours * sign - want).max() < 1e-8
        assert all(int(by[i, k + 1]["deviation"]) == d and by[i, k + 1]["n"] == n for i, d in zip(ids, deviation, strict=True))
        assert all(abs(by[i, k + 1]["explained"] - shares[k]) < 1e-10 and by[i, k + 1]["identity_error"] < 1e-10 for i in ids)


def test_rank_one_updates_against_eigh():
    rng = np.random.default_rng(1)
    for m in (1, 2, 7, 20):
        d = np.sort(rng.integers(0, 4, size=(5, m)).astype(float), axis=1)  # many equal eigenvalues
        u = np.stack([np.linalg.qr(rng.normal(size=(m, m)))[0] for _ in range(5)])
        v = rng.normal(size=(5, m))
        v[1] = 0
        v[2] = u[2, :, 0]
        weight = rng.random(5)
        weight[3] = 0
        values, vectors = whitening.rank_one(d, u, v, weight)
        for k in range(5):
            whole = u[k] * d[k] @ u[k].T + weight[k] * np.outer(v[k], v[k])
            assert np.abs(vectors[k] * values[k] @ vectors[k].T - whole).max() < 1e-12
            assert np.abs(vectors[k].T @ vectors[k] - np.eye(m)).max() < 1e-12


def test_spectra_of_streams_against_the_scatter_matrix():
    rng = np.random.default_rng(2)
    x = np.floor(rng.normal(size=(700, 12)) * np.linspace(1, 60, 12)) + 1000
    s = whitening.Spectra(5, 12)
    for i in range(0, len(x), 5):
        s.add(x[i : i + 5])
    s.fold()
    away = x - x.mean(axis=0)
    want = away.T @ away
    assert s.n[0] == 700 and np.abs(s.mean[0] - x.mean(axis=0)).max() < 1e-10
    assert np.abs(s.vectors[0] * s.values[0] @ s.vectors[0].T - want).max() < 1e-11 * want.max()


def test_short_streams_of_vectors_with_equal_entries():
    """Fewer vectors than dimensions, entries that are often equal or zero: most eigenvalues are 0, many entries of an update as well."""
    rng = np.random.default_rng(8)
    for trial in range(60):
        m, n = 24, (1, 2, 3, 5, 12, 40)[trial % 6]
        x = rng.integers(-1, 2, size=(n * 4, m)).astype(float) * rng.integers(0, 2, size=m)
        s = whitening.Spectra(4, m)
        for i in range(0, len(x), 4):
            s.add(x[i : i + 4])
        s.fold()
        away = x - x.mean(axis=0)
        assert np.abs(s.vectors[0] * s.values[0] @ s.vectors[0].T - away.T @ away).max() < 1e-11 * max(1, np.abs(away.T @ away).max())
        assert np.abs(s.vectors[0].T @ s.vectors[0] - np.eye(m)).max() < 1e-11


def test_whitening_of_a_whole_table(spark):
    sf = "/root/testdata/sf0.01"
    rows = queries.op11_whitening(spark, sf).collect()
    table = spark.read.parquet(f"{sf}/embeddings.parquet").collect()
    check_white(rows, [r["vec_id"] for r in table], [r["embedding"] for r in table])


def test_whitening_of_awkward_rows(spark):
    rng = np.random.default_rng(3)
    good = [[float(v) for v in row] for row in rng.normal(size=(60, 6)) * [3, 1, 2, 5, 4, 0.5]]
    good += [good[0]] * 30  # a third of all rows is one vector
    bad = [None, [], [float("nan")] * 6, [1.0, None, 0.0, 0.0, 0.0, 0.0], [float("inf")] * 6, [1e300] * 6, [1.0, 2.0]]
    rows = [(i, v, "x") for i, v in enumerate([*good, *bad])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, whitened string").repartition(7)
    check_white(whitening.whiten(df).collect(), list(range(len(good))), good)


def test_whitening_without_variance_and_without_rows(spark):
    one = spark.createDataFrame([(1, [0.5, 0.25]), (None, [0.5, 0.25])], "vec_id long, embedding array<float>")
    got = whitening.whiten(one).collect()
    assert len(got) == 4 and all(r["whitened"] is None and r["explained"] == 0 and r["n"] == 1 and r["deviation"] == 0 and r["identity_error"] == 0 for r in got)
    line = spark.createDataFrame([(i, [float(i), float(i)]) for i in range(9)], "vec_id long, embedding array<float>")
    got = whitening.whiten(line).collect()
    assert all((r["whitened"] is None) == (r["component"] == 2) for r in got) and {round(r["explained"], 12) for r in got} == {0.0, 1.0}
    assert whitening.whiten(one.limit(0)).collect() == [] and whitening.whiten(one.limit(0)).columns == whitening.whiten(one).columns


def test_refinement_finds_directions_that_the_basis_lacks(spark):
    rng = np.random.default_rng(4)
    x = np.floor(rng.normal(size=(400, 10)) * np.linspace(1, 90, 10)).astype(int)
    fit = spark.createDataFrame([([int(v) for v in r],) for r in np.unique(x, axis=0)], "x array<long>").repartition(3)
    rows = np.unique(x, axis=0)
    v = np.cov(rows.T, bias=True)
    values, axes = whitening.refine(fit, rows.mean(axis=0), np.eye(10)[:, :3], 2)
    assert np.allclose(values, np.linalg.eigvalsh(v)[::-1][:2], rtol=1e-10)
    assert np.abs(v @ axes - axes * values).max() < 1e-8


# --- spelling -------------------------------------------------------------------------------------


def near(a, b):
    if len(a) > len(b):
        a, b = b, a
    if a == b or len(b) - len(a) > 1:
        return False
    return sum(x != y for x, y in zip(a, b, strict=True)) == 1 if len(a) == len(b) else any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def variants(rows):
    counts = Counter()
    for i, t in rows:
        for r in re.findall("[a-zÀ-ÿ]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in t or "")):
            h = zlib.crc32(f"{'' if i is None else i}:{r}".encode())
            counts[r[: h % len(r)] + r[h % len(r) + 1 :] if h % 97 == 0 else r] += 1
    counts = {w: n for w, n in counts.items() if len(w) >= 5 and n >= 3}
    boxes = {}
    for w in counts:
        for key in {w, *(w[:i] + w[i + 1 :] for i in range(len(w)))}:
            boxes.setdefault(key, []).append(w)
    beside = {w: set() for w in counts}
    for box in boxes.values():
        for a in box:
            beside[a].update(b for b in box if near(a, b))
    form = {}
    for w, others in beside.items():
        best = min(others, key=lambda x: (-counts[x], x), default=None)
        if best is not None and counts[best] >= 2 * counts[w]:
            form[w] = best
    out = set()
    for w in counts:
        root = w
        while root in form:
            root = form[root]
        out.add((w, form.get(w), root, counts[w], len(beside[w]), counts.get(form.get(w))))
    return out


def test_variants_of_a_whole_table_against_brute_force(spark):
    sf = "/root/testdata/sf0.001"
    rows = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()
    got = [tuple(r) for r in queries.op12_spelling_variants(spark, sf).collect()]
    want = variants([tuple(r) for r in rows])
    assert len(got) == len(want) and set(got) == want and any(r[1] is not None and r[1] != r[2] for r in want)


def test_variants_of_planted_edits(spark):
    """Words that all begin alike, chains of forms, ties, edits at every place, accents, and edits of short words."""
    rng = random.Random(3)
    base = "untereinander"
    words = {base: 90}
    for i in range(len(base)):
        words[base[:i] + base[i + 1 :]] = 5
        words[base[:i] + "ß" + base[i + 1 :]] = 7
        words[base[:i] + "x" + base[i:]] = 11
    words |= {"unterx" + "".join(rng.choice("abc") for _ in range(4)): rng.randint(3, 20) for _ in range(300)}
    words |= {"eeeee": 40, "eeeeee": 20, "eeeeeee": 10, "eeeeeeee": 5, "àéîõü": 8, "àéîõ": 9, "àéîõüa": 4, "aaaab": 6, "aaaac": 6, "aaaad": 3}
    rows = [(i, " ".join([w.upper() if w.isascii() and k % 3 == 0 else w] * 1)) for i, (w, n) in enumerate(words.items()) for k in range(n)]
    rows += [(None, "eeeee, EEEEE; none"), (5, None), (6, ""), (7, "12 34 _ -")]
    df = spark.createDataFrame([(i, t, "w", 1) for i, t in rows], "doc_id long, text string, word string, n int").repartition(5)
    got = [tuple(r) for r in spelling.spelling_variants(df).collect()]
    assert len(got) == len(set(got)) and set(got) == variants(rows)


def test_chunk_keys_meet_for_every_edit(spark):
    rng = random.Random(9)
    words = set()
    for n in range(5, 13):
        w = "".join(rng.choice("abcdefgh") for _ in range(n))
        words |= {w} | {w[:i] + w[i + 1 :] for i in range(n)} | {w[:i] + "z" + w[i + 1 :] for i in range(n)} | {w[:i] + "z" + w[i:] for i in range(n + 1)}
    words = {w for w in words if len(w) >= 5}
    df = spark.createDataFrame([(w, 3) for w in words], "word string, n long")
    got = {(r["word"], r["near"]) for r in spelling.near_words(df).collect()}
    assert got == {(a, b) for a in words for b in words if near(a, b)}


def test_variants_without_words(docs, empty):
    assert spelling.spelling_variants(empty).collect() == []
    assert spelling.spelling_variants(docs.filter("doc_id = 3")).collect() == []


# --- secrets --------------------------------------------------------------------------------------


def base_digest(text):
    text = text or ""
    found = [("assign", *m.span()) for m in re.finditer(r"""(?ai)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", text) if len(m[2]) >= 6]
    found += [("access", *m.span()) for m in re.finditer("AKIA[A-Z0-9]+", text) if len(m[0]) >= 20]
    found += [("hex", *m.span()) for m in re.finditer("[0-9a-f]+", text) if len(m[0]) >= 24]
    order = ["assign", "access", "hex"]
    found.sort(key=lambda x: (x[1], order.index(x[0])))
    joined = ",".join(f"{k}:{s}:{e}" for k, s, e in found)
    return tuple(sum(k == o for k, _, _ in found) for o in order) + (hashlib.sha256(joined.encode()).hexdigest(),), joined


def test_base_spans_of_a_whole_table(spark):
    sf = "/root/testdata/sf0.001"
    rows = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()
    got = {r["doc_id"]: r for r in queries.op13_secret_scan(spark, sf).collect()}
    assert len(got) == len(rows)
    for i, t in rows:
        want, joined = base_digest(t)
        assert tuple(got[i][c] for c in ("n_assign", "n_access", "n_hex", "base_sha256")) == want
        assert [x for x in got[i]["spans"].split(",") if x and not x.startswith("learned")] == [x for x in joined.split(",") if x]


def test_base_spans_of_awkward_texts():
    key = "AKIA" + "Z9" * 8
    for t in [
        "", "token: abc", "token = token=abcdefgh", "secret: token : abcdefgh", 'API_KEY"="abcdef', "apikey='a-b/c+d'", "ſecret=abcdefgh", "PASSWORD   :   xyz.xyz", key, key[:-1], "xx" + key + key,
        "deadbeef" * 3, "deadbeef" * 2, "日本 token=" + "deadbeef" * 5 + " é", "password==abcde", "passwd:\tabcdefgh", "secrettoken=abcdefgh",
    ]:
        low = "".join(c.lower() if "A" <= c <= "Z" else c for c in t)
        found = sorted(secret_scan.base_spans(t, low), key=lambda x: (x[1], secret_scan.KINDS.index(x[0])))
        assert ",".join(f"{k}:{s}:{e}" for k, s, e in found) == base_digest(t)[1]


def made_findings(seed, n):
    rng = random.Random(seed)
    word = lambda a, b: "".join(rng.choice("etaoinshrdlu") for _ in range(rng.randint(a, b)))
    hexes = lambda: "".join(rng.choice("0123456789abcdef") for _ in range(40))
    out = []
    for k in range(n):
        lead, trail = f" {word(3, 7)} {word(2, 6)} "[-16:], f" {word(4, 9)}"[:8]
        out.append(("ing token = \"", hexes(), '" and th', 1))
        plain = [word(12, 20), f"{word(5, 9)}.{rng.randint(10, 99)}", "".join(rng.choice("0123456789") for _ in range(16)), f"{word(4, 8)}.example.com"][k % 4]
        out.append((lead, plain.ljust(12, "e"), trail, 0))
    return out


@pytest.fixture(scope="module")
def model():
    return secret_scan.train(made_findings(1, 250), made_findings(2, 120))


def test_network_gradients():
    rng = np.random.default_rng(0)
    codes, n, _ = secret_scan._coded(made_findings(4, 3))
    label = np.array([1, 0] * 3, np.float64)[: len(codes)]
    p = {k: v.astype(np.float64) for k, v in secret_scan.fit_network(codes, n, label.astype(np.float32), epochs=1).items()}
    loss = lambda q: np.mean(np.logaddexp(0, (z := secret_scan._forward(q, codes, n)["logit"])) - label * z)
    g = secret_scan._gradients(p, codes, n, label)
    for name, value in p.items():
        place = tuple(rng.integers(s) for s in value.shape) if name != "embed" else (int(codes[0, secret_scan.BEFORE + 3]), 2)
        up, down = {k: v.copy() for k, v in p.items()}, {k: v.copy() for k, v in p.items()}
        up[name][place] += 1e-5
        down[name][place] -= 1e-5
        assert abs((loss(up) - loss(down)) / 2e-5 - g[name][place]) < 1e-4


def test_network_finds_secrets_that_no_rule_names(spark, model):
    secret = ["9F8E7D6C5B4A39281706F5E4D3C2B1A0FFEE", "Zx8Qp1Lm0Vt7Rk3Ws9Yb2Nc6Hd4Jf5Gg", "sk-aB3dE6gH9jK2mN5pQ8sT1vW4yZ7cF0iL"]
    rows = [(i, f"the nation {s} of oleander") for i, s in enumerate(secret)] + [(10, "onother tonnenteilrohre and anderlestone.example.com with 4111111111111111"), (11, None), (11, ""), (None, "token = \"" + "ab12" * 10 + "\"")]
    df = spark.createDataFrame([(i, t, "x") for i, t in rows], "doc_id long, text string, spans string")
    got = {(r["doc_id"], k): r["spans"] for k, r in enumerate(secret_scan.find_secrets(df, model).coalesce(1).orderBy(secret_scan.F.desc_nulls_last("doc_id")).collect())}
    spans = {i: s for (i, _), s in got.items()}
    for i, s in enumerate(secret):
        assert [(x["kind"], x["start"], x["end"]) for x in spans[i]] == [("learned", 11, 11 + len(s))] and spans[i][0]["score"] > 0.5
    assert spans[10] == [] and spans[11] == [] and [x["kind"] for x in spans[None]] == ["assign", "hex"] and len(got) == 7


def test_recall_on_held_out_findings(model):
    held = made_findings(3, 200)
    codes, n, owner = secret_scan._coded(held)
    best = np.zeros(len(held))
    np.maximum.at(best, owner, secret_scan.model_scores(model, codes, n))
    found = np.array([s >= model.thresholds[secret_scan.shape(x[1])] for s, x in zip(best, held, strict=True)])
    label = np.array([x[3] for x in held])
    assert found[label == 1].mean() >= 0.95 and found[label == 0].mean() <= 0.03


def test_long_candidates_and_texts(spark, model):
    tail = "Zx8Qp1Lm0Vt7Rk3Ws9Yb2Nc6Hd4Jf5GgPq3Rt6Yw9Zb1Xc"
    long = "n" * 300 + "." + tail
    rows = [(1, long), (2, ("anon the stone " * 150_000) + tail)]
    got = {r["doc_id"]: [(x["start"], x["end"]) for x in r["spans"]] for r in secret_scan.find_secrets(spark.createDataFrame(rows, "doc_id long, text string"), model).collect()}
    assert got[1] == [(0, len(long))] and got[2] == [(15 * 150_000, 15 * 150_000 + len(tail))]


def test_without_findings_only_rules_count(spark, docs, empty):
    assert secret_scan.find_secrets(empty).collect() == []
    assert secret_scan.train([], []) is None and secret_scan.train([("", "a" * 12, "", 0)], [("", "a" * 12, "", 0)]) is None
    assert all(x["kind"] != "learned" for r in secret_scan.find_secrets(docs).collect() for x in r["spans"])


def test_model_rests_on_all_findings(spark, monkeypatch):
    F = secret_scan.F
    word = F.substring(F.translate(F.md5(F.col("doc_id").cast("string")), "0123456789", "ghijklmnop"), 1, 14)
    key = F.concat(F.lit('token = "'), F.sha1(F.col("doc_id").cast("string")), F.lit('"'))
    docs = spark.range(24_000).withColumnRenamed("id", "doc_id").withColumn("text", F.concat(F.lit("see "), F.when(F.col("doc_id") % 40 == 0, key).otherwise(word), F.lit(" there")))
    found = secret_scan.findings(docs)
    assert found.count() == 24_000
    have = {(r["held"], r["label"]): r["count"] for r in found.groupBy("held", "label").count().collect()}
    seen = []
    monkeypatch.setattr(secret_scan, "ROUNDS", 0)
    monkeypatch.setattr(secret_scan, "_calibrated", lambda p, counts: seen.append(counts))
    assert secret_scan.fit_model(found.union(found)) is None
    # Every other finding that isn't a secret also stands behind a keyword; equal findings count once.
    plain = have[True, 0]
    assert plain > 3000 and sum(n for (_, label, _), n in seen[0].items() if not label) == plain + (plain + 1) // 2


def test_line_of_scores_far_apart():
    logit, label, count = np.array([-30.0, -22.0, 18.0, 25.0]), np.array([0.0, 0.0, 1.0, 1.0]), np.array([40_000.0, 60_000.0, 50.0, 950.0])
    slope, offset = secret_scan._platt(logit, label, count)
    q, t = 1 / (1 + np.exp(-(slope * logit + offset))), np.where(label == 1, 1001 / 1002, 1 / 100_002)
    assert 0 < slope < 2 and np.all((q > 0.5) == (label == 1))
    assert abs((count * (q - t)).sum()) < 1e-3 and abs((count * (q - t) * logit).sum()) < 1e-2


def test_rounds_use_every_group():
    for groups in (1, 2, 5, 64, 1000):
        rounds = secret_scan._rounds(groups)
        once = [g for low, high in rounds[: groups.bit_length()] for g in range(low, high)]
        assert once == list(range(groups)) and len(rounds) >= secret_scan.ROUNDS and set(rounds[groups.bit_length() :]) <= {(0, groups)}


def test_model_of_groups_does_not_depend_on_partitions(spark, monkeypatch):
    monkeypatch.setattr(secret_scan, "GROUP", 150)
    rows = [(held, y, a, b, c) for held, seed, n in ((False, 1, 250), (True, 2, 120)) for a, b, c, y in made_findings(seed, n)]
    found = spark.createDataFrame(rows, "held boolean, label int, lead string, found string, trail string")
    one, other = (secret_scan.fit_model(found.repartition(k)) for k in (1, 7))
    assert all(np.array_equal(a, b) for a, b in zip(one[:7], other[:7], strict=True)) and one[7:] == other[7:]
    held = made_findings(3, 200)
    codes, n, owner = secret_scan._coded(held)
    best = np.zeros(len(held))
    np.maximum.at(best, owner, secret_scan.model_scores(one, codes, n))
    hit = np.array([s >= one.thresholds[secret_scan.shape(x[1])] for s, x in zip(best, held, strict=True)])
    label = np.array([x[3] for x in held])
    assert hit[label == 1].mean() >= 0.95 and hit[label == 0].mean() <= 0.2

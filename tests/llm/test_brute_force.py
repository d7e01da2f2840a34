"""Operators against brute-force versions on small fixtures."""

import re
import zlib

import duckdb
import numpy as np
import public_tokenizers
import pytest
import xxhash
from tokenizers import Tokenizer

from tidemark.llm import components, licenses, mixing, packing, pages, pii, quality, queries, simhash, tokens, toxicity, vectors

BPE = public_tokenizers.path("byte_bpe_50k.json")


def groups(pairs, nodes):
    parent = {n: n for n in nodes}

    def root(n):
        while parent[n] != n:
            n = parent[n]
        return n

    for a, b in pairs:
        x, y = root(a), root(b)
        parent[max(x, y)] = min(x, y)
    return {n: root(n) for n in nodes}


def test_components(spark):
    rng = np.random.default_rng(1)
    edges = [(int(a), int(b)) for a, b in rng.integers(0, 400, (300, 2))] + [(k, k + 1) for k in range(1000, 1200)] + [(5000, 5000 + k) for k in range(1, 300)]
    got = {r["node"]: r["component"] for r in components.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    want = groups(edges, {n for e in edges if e[0] != e[1] for n in e})
    assert got == want


# ---------------------------------------------------------------- 1, 2


def test_licenses_find_what_exact_containment_finds(documents, prose):
    index = licenses.Index(licenses.NOTICES)
    mit = licenses.NOTICES["MIT-permission"].split()
    texts = [prose(1, 300) + " " + licenses.NOTICES["MIT"] + " " + prose(2, 40), prose(3, 500)]
    for k in range(40):  # notices that lost a few words, at many places
        cut = [w for i, w in enumerate(mit) if (i + k) % 30]
        texts.append(prose(k, 3 * k) + " " + " ".join(cut) + " " + prose(k + 50, 2 * k))
    got = {(r["doc_id"], r["license"]): r["containment"] for r in licenses.scan(documents(list(enumerate(texts)))).collect()}
    want = {}
    for c in index.classes:
        for d, text in enumerate(texts):
            words = [licenses.normal(w) for w in licenses.words_of(text)]
            for t, shingles in enumerate(index.shingles):
                if len(next(iter(shingles))) != c.k or not any(t in members for table in c.tables for members in table.values()):
                    continue
                for at in range(0, len(words), c.block):
                    part = words[at : at + 2 * c.block + c.k - 1]
                    held = {tuple(part[i : i + c.k]) for i in range(len(part) - c.k + 1)} & shingles
                    if len(held) / len(shingles) >= licenses.CONTAINMENT:
                        key = (d, index.names[t])
                        want[key] = max(want.get(key, 0), len(held) / len(shingles))
    assert got == want and (0, "MIT") in got and sum(k[1] == "MIT-permission" for k in got) > 30


def test_mixing_meets_the_targets_and_the_optimum(spark, documents, prose):
    rng = np.random.default_rng(2)
    rows = [(i, prose(i, int(rng.integers(20, 80))) + (" zork" * 6 if i % 5 == 0 else "")) for i in range(600)]
    labelled = spark.createDataFrame([(i, "b" if i % 5 == 0 else "a") for i in range(0, 600, 2)], "doc_id long, domain string")
    got = mixing.mix(documents(rows), labelled, {"a": 0.6, "b": 0.4}).collect()
    n = np.array([r["tokens"] for r in got], float)
    p = np.array([[r["p_a"], r["p_b"]] for r in got])
    rate = np.array([r["rate"] for r in got])
    assert (n > 0).all() and np.allclose(p.sum(1), 1) and (rate >= 0).all()
    held = np.array([r["doc_id"] % 5 == 0 for r in got])
    assert ((p[:, 1] > 0.5) == held).mean() > 0.95
    share = (n * rate) @ p / n.sum()
    assert np.abs(share - [0.6, 0.4]).max() < 0.01
    # Plain projected gradient descent, run long, comes to the same rates.
    target, weight, r = np.array([0.6, 0.4]), 1 / ((n @ p**2) / n.sum()), np.ones(len(n))
    for _ in range(4000):
        g = (n * r) @ p / n.sum() - target
        r = np.maximum(0, r - 0.3 * (p @ (weight * g) + mixing.RIDGE * (r - 1)))
    assert np.abs(r - rate).max() < 0.02
    assert abs(sum(x["copies"] for x in got) - rate.sum()) < 4 * np.sqrt(len(got))


# ---------------------------------------------------------------- 3, 4


def test_vectors_equal_all_pairs(spark):
    rng = np.random.default_rng(4)
    base = rng.standard_normal((300, 16))
    near = base[:60].repeat(5, 0) + 0.12 * rng.standard_normal((300, 16))
    dense = base[70] + 0.02 * rng.standard_normal((700, 16))
    x = np.concatenate([base, near, dense, base[:20]]).astype(np.float32)
    table = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<float>")
    got = {r["vec_id"]: (r["n_links"], r["component_id"]) for r in vectors.dedup(table, codes=8).collect()}
    u = vectors.unit(x)
    linked = u @ u.T >= 0.95
    n = linked.sum(1) - 1
    component = groups(zip(*np.nonzero(linked), strict=True), range(len(x)))
    found = sum(g[0] for g in got.values()) / n.sum()
    assert found > 0.99 and all(got[i][0] <= n[i] for i in range(len(x)))
    assert np.mean([got[i][1] == component[i] for i in range(len(x))]) > 0.99


def fingerprint(text):
    words = re.findall(rb"[^\x20\x09-\x0D]+", re.sub(rb"[A-Z]", lambda m: m.group().lower(), (text or "").encode()))
    shingles = [b" ".join(words[i : i + 3]) for i in range(len(words) - 2)] or ([b" ".join(words)] if words else [])
    h = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def test_simhash_equals_all_pairs(documents, prose):
    rows = [(i, prose(i, 40)) for i in range(30)]
    for i in range(30, 160):  # near copies with one or two words changed
        words = prose(i % 12, 120).split()
        words[i % 100] = f"w{i}"
        rows.append((i, " ".join(words)))
    rows += [(200, "ÉTÉ Was so"), (201, "One two"), (202, None), (203, ""), (204, "\x1cA b\x0bc")]
    got = {r["doc_id"]: r for r in simhash.dedup(documents(rows)).collect()}
    prints = {i: fingerprint(t) for i, t in rows}
    assert all(got[i]["fp"] % 2**64 == f for i, f in prints.items())
    ids = list(prints)
    component = groups([(a, b) for a in ids for b in ids if (prints[a] ^ prints[b]).bit_count() <= 3], ids)
    assert {i: got[i]["component_id"] for i in ids} == component
    assert len(set(component.values())) < len(ids) - 20
    kept = {r["doc_id"] for r in simhash.keep(documents(rows)).collect()}
    assert kept == set(component.values())


def test_links_of_a_dense_group(spark):
    from itertools import combinations

    rng = np.random.default_rng(5)
    base = [int(x) for x in rng.integers(0, 2**63, 60)]
    fps = set(base)
    for b in base[:20]:
        for _ in range(5):
            fps.add(b ^ sum(1 << int(i) for i in rng.choice(63, rng.integers(1, 5), replace=False)))
    bits = [int(i) for i in rng.choice(63, 8, replace=False)]
    fps |= {base[30] ^ sum(1 << b for b in c) for k in range(5) for c in combinations(bits, k)}
    fps = sorted(fps)
    got = {r["fp"]: r["comp"] for r in simhash.link(spark.createDataFrame([(f,) for f in fps], "fp long")).collect()}
    signed = {f: f for f in fps}
    want = groups([(a, b) for a in fps for b in fps if ((a ^ b) % 2**64).bit_count() <= 3], fps)
    assert got == {signed[f]: want[f] for f in fps}


def test_anchors_cover():
    """Two words of distance 3 always meet where one of them is at home."""
    rng = np.random.default_rng(6)
    a = rng.integers(-(2**63), 2**63 - 1, 300)
    b = np.array([x ^ np.bitwise_xor.reduce([np.int64(np.uint64(1) << np.uint64(i)) for i in rng.choice(64, 3, replace=False)]) for x in a])
    at = {}
    for side, fp in (("a", a), ("b", b)):
        for rows, anchor, home in simhash.anchors(fp):
            for r, x in zip(rows, anchor, strict=True):
                at.setdefault((r, x), set()).add((side, home))
    meets = {r for (r, _), s in at.items() if len({side for side, _ in s}) == 2 and any(h for _, h in s)}
    assert meets == set(range(300))


# ---------------------------------------------------------------- 5, 6


def test_toxicity_on_held_out_rows(spark, documents, prose):
    bad = ["grumbolt", "snarfwit", "vexnard"]
    rows = [(i, prose(i, 80) + (" " + " ".join(bad) + " " + prose(i + 1000, 20) if i % 4 == 0 else "")) for i in range(400)]
    labels = spark.createDataFrame([(i, int(i % 4 == 0)) for i in range(400)], "doc_id long, toxic int")
    got = toxicity.score(documents(rows), toxicity.train(documents(rows), labels)).collect()
    for r in got:
        assert r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 3 == 1)
        assert r["predicted"] == int(r["score"] >= 0.7) and 0 <= r["score"] <= 1
    held = [r for r in got if r["held_out"]]
    assert np.mean([r["predicted"] == int(r["doc_id"] % 4 == 0) for r in held]) > 0.95


def test_windows_are_the_whole_text():
    for text in (b"", b"a", b" " * 500, b"x" * 1000, b"ab cd " * 100):
        cut = toxicity.windows(text)
        assert b"".join(cut) == text and all(0 < len(w) <= toxicity.WINDOW for w in cut)


PATTERNS = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def base_spans(text):
    out = []
    for kind, pattern in PATTERNS.items():
        for m in re.finditer(pattern, text):
            digits = [c for c in m.group() if c in "0123456789"]
            good = {"email": True, "ip": kind != "ip" or all(int(p) <= 255 for p in m.group().split(".")), "card": 14 <= len(digits) <= 19 and pii.luhn("".join(digits)), "phone": 10 <= len(digits) <= 15}
            if good[kind]:
                out.append((kind, *m.span()))
    return pii.ordered(out)


def test_base_patterns_equal_plain_regular_expressions():
    rng = np.random.default_rng(7)
    parts = [*"0123456789ab.@+- ()é\n@..", "4532015112830366", "+1 (269) 555-3296", "a.b@c.de", "1.2.3.4"]
    for _ in range(5000):
        text = "".join(rng.choice(parts, rng.integers(0, 20)))
        assert pii.matches(text)[0] == base_spans(text)


def test_the_field_finds_what_the_patterns_drop(documents, prose):
    rows = []
    for i in range(300):
        kind = i % 5
        extra = ["", f"user{i}@mail.example.com", f"10.0.{i % 250}.7", "4532015112830366", f"+1 (2{i % 90 + 10}) 555-{1000 + i}"][kind]
        rows.append((i, f"{prose(i, 30)} {extra} {prose(i + 999, 30)} version {i % 7}.0"))
    table = documents([*rows, (900, prose(900, 20) + " +1 (269) 555-3296 4532015112830366 " + prose(901, 20))])
    got = {r["doc_id"]: r for r in pii.find(table).collect()}
    text = dict((r["doc_id"], r["text"]) for r in table.collect())
    for i, r in got.items():
        assert set(pii.listed(base_spans(text[i])).split(",")) <= set(r["spans"].split(",")) | {""}
    both = got[900]
    assert both["n_card"] == both["n_phone"] == 0 and both["n_added"] == 2
    assert {s.split(":")[0] for s in both["spans"].split(",")} == {"phone", "card"}
    assert all(got[i]["n_added"] == 0 for i in range(300))


def test_decoding_equals_trying_all_paths():
    from itertools import product

    rng = np.random.default_rng(8)
    field = pii.Field({}, np.zeros((0, 9)), rng.standard_normal((9, 9)), rng.standard_normal(9))
    batch = [rng.standard_normal((n, 9)) for n in (1, 2, 3, 4, 1, 3)]
    for x, path in zip(batch, field.decode(batch), strict=True):
        def total(tags, x=x):
            return field.begin[tags[0]] + sum(x[t, k] for t, k in enumerate(tags)) + sum(field.move[a, b] for a, b in zip(tags, tags[1:], strict=False))

        assert tuple(path) == max(product(range(9), repeat=len(x)), key=total)


# ---------------------------------------------------------------- 7, 8


PAGE = """<!DOCTYPE html><html><head><title>T</title><script>var a="<p>no</p>";</script></head><body>
<div class="cookie-notice">We use cookies on this site, accept all of them</div><header><nav><a href="/">Home</a></nav></header>
<article><h1>Head &amp; line</h1><p>One   two\nthree<br>four &eacute;.<p>With <a href="/?id=nav">a link</a>.<div class="ad">Buy</div><ul><li>item</li></ul></article>
<div id="comments"><p>nice post I like it a lot really</p></div><aside>more</aside><form>Name</form><footer>&copy; x</footer></body>"""


def test_main_text(spark):
    table = spark.createDataFrame([(i, "u", PAGE.replace("One", f"One{i}")) for i in range(20)], "page_id long, url string, html string")
    got = {r["page_id"]: r for r in pages.texts(table).collect()}
    for i in range(20):
        want = f"Head & line\n\nOne{i} two three four é.\n\nWith a link.\n\nitem"
        assert got[i]["text"] == want and got[i]["n_chars"] == len(want)


def test_region_is_the_best_contiguous_run():
    rng = np.random.default_rng(9)
    for _ in range(200):
        parts = [pages.Piece("p" if rng.random() < 0.4 else "", "a " * int(rng.integers(0, 4)), False, False) for _ in range(12)]
        score = {"p": -2.5}
        value = [score["p"] if p.kind else len(p.text.split()) for p in parts]
        a, b = pages.region(parts, score)
        assert sum(value[a:b]) == max([0, *(sum(value[i:j]) for i in range(12) for j in range(i + 1, 13))])


def test_encoder_equals_the_tokenizer():
    plain, encode = Tokenizer.from_file(BPE), packing.Encoder(BPE)
    rng = np.random.default_rng(10)
    parts = [*"ab c\n\t  \r'sé日1.,! 　 \x1c\xa0\x85​", "<|endoftext|>", " the", "n't", "word, word."]
    for _ in range(5000):
        text = "".join(rng.choice(parts, rng.integers(0, 25)))
        assert encode(text) == np.array(plain.encode(text, add_special_tokens=False).ids, "<u4").tobytes()


def test_packing_is_a_round_trip(documents, prose):
    rows = [(i, prose(i, 5 + 40 * (i % 60))) for i in range(150)]
    got = packing.pack(documents(rows), BPE, pool=20_000).collect()
    plain = Tokenizer.from_file(BPE)
    ids = {i: [*plain.encode(t, add_special_tokens=False).ids, 1] for i, t in rows}
    by_doc, by_seq = {}, {}
    for r in got:
        by_doc.setdefault(r["doc_id"], []).append((r["start"], r["length"]))
        by_seq.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
        piece = ids[r["doc_id"]][r["start"] : r["start"] + r["length"]]
        assert r["ids_crc32"] == zlib.crc32(np.array(piece, "<u4").tobytes()) and r["doc_tokens"] == len(ids[r["doc_id"]])
    for k, want in [*((k, len(ids[i])) for i, k in ((i, by_doc[i]) for i in ids)), *((v, None) for v in by_seq.values())]:
        at = 0
        for start, n in sorted(k):
            assert start == at
            at += n
        assert at == want if want else at <= packing.LENGTH
    total = sum(map(len, ids.values()))
    assert len(by_seq) <= total / packing.LENGTH + total / 20_000 + 9


def test_assignment_balances_the_cost():
    rng = np.random.default_rng(11)
    pieces = packing.assign([int(n) for n in rng.integers(1, 1500, 300)])
    cost = {}
    for _, _, n, seq, _ in pieces:
        cost[seq] = cost.get(seq, 0) + n + packing.QUADRATIC * n * n
    full = np.array(sorted(cost.values()))[1:]
    assert full.max() / full.mean() < 1.35


# ---------------------------------------------------------------- 9, 10


def test_token_counts_equal_plain_dynamic_programming(documents):
    model = tokens.Unigram({b"a": 0, b"b": 1, b"ab": 2, b"abab": 5, b"ba": 3, b"c": 9, b"abc": 4})
    rng = np.random.default_rng(12)
    words = sorted({bytes(rng.choice(list(b"abcd"), rng.integers(0, 10)).tolist()) for _ in range(2000)} | {b"ab" * 300})
    for word, (n, score) in zip(words, tokens.forward(words, model), strict=True):
        best = [(0.0, 0)]
        for end in range(1, len(word) + 1):
            ways = []
            for start in range(max(0, end - 8), end):
                s = model.scores.get(word[start:end], model.unknown if end - start == 1 else None)
                if s is not None:
                    ways.append((best[start][0] + s, best[start][1] + 1))
            best.append(max(ways, key=lambda w: w[0]))
        assert n == best[-1][1] and score == pytest.approx(best[-1][0])


def test_quality_equals_its_sql(spark, documents, prose):
    line = prose(777, 13)
    rows = [(i, f"{prose(i, 30)}\n{line}\n{prose(i + 500, 3)}") for i in range(150)]
    rows += [(200 + i, f"{line}\n{prose(i, 3)} {i}\n{line}") for i in range(5)]
    rows += [(300, "a b c d e f g h " * 5), (301, None), (302, "x #*$ y\nx #*$ y")]
    table = documents(rows)
    got = quality.assess(table).drop("host", "content").toPandas().sort_values("doc_id").reset_index(drop=True)
    con = duckdb.connect()
    con.register("documents", table.select("doc_id", "text", "source").toPandas())
    want = con.sql(queries.QUALITY_SQL).df()[list(got.columns)].sort_values("doc_id").reset_index(drop=True)
    assert (got == want).all().all()
    kept = dict(zip(got["doc_id"], got["kept"], strict=True))
    assert all(kept[i] for i in range(150)) and not kept[201] and not kept[300] and not kept[301]


def test_frequent_lines_are_cut_from_kept_documents(spark, documents, prose):
    line, rare = prose(777, 13), prose(778, 9)
    rows = [(i, f"{prose(i, 30)}\n{line}\n\n{rare if i < 5 else f'x{i}'}\n {line.upper()} \n{prose(i + 500, 3)}") for i in range(150)]
    rows += [(200 + i, rows[k][1]) for i, k in enumerate((0, 7))] + [(300, f"{line}\n{line}\nx y"), (301, prose(5, 25))]
    table = documents(rows)
    got = {r["doc_id"]: r for r in quality.keep(table).collect()}
    assert set(got) == {*range(150), 200, 201, 301}
    for i, text in rows:
        if i == 300:
            continue
        lines = text.split("\n")
        # The first document and its copy keep the line; the rare one is no more frequent than the limit.
        want = text if i in (0, 200, 301) else "\n".join(x for x in lines if x.strip().lower() != line)
        assert got[i]["text"] == want and got[i]["n_chars"] == len(want)
    lost = {r["doc_id"]: r["n_words"] - r["n_words_left"] for r in quality.assess(table).collect()}
    assert all(lost[i] == len(dict(rows)[i].split()) - len(got[i]["text"].split()) for i in got)


def test_the_line_limit_grows_with_the_host(spark, documents, prose):
    """More than five different texts and more than five per cent of the host's; copies count once."""
    holders = {"five": (5, 5), "six": (6, 6), "share": (20, 400), "over": (21, 400), "copies": (5, 6)}
    rows, hosts, n = [], {}, 0
    for host, (with_line, texts) in holders.items():
        for i in range(texts):
            rows.append((n, f"{prose(n, 30)}\n{host} line of the host" if i < with_line else prose(n, 30)))
            hosts[n], n = host, n + 1
    for _ in range(9):  # of a text with the line
        rows.append((n, next(t for i, t in rows if hosts[i] == "copies")))
        hosts[n], n = "copies", n + 1
    of = spark.createDataFrame(list(hosts.items()), "doc_id long, source string")
    table = documents(rows).drop("source").join(of, "doc_id")
    got = quality.assess(table).drop("content").toPandas().sort_values("doc_id").reset_index(drop=True)
    removed = got.groupby("host")["n_lines_removed"].sum().to_dict()
    assert removed == {"five": 0, "six": 5, "share": 0, "over": 20, "copies": 0}
    con = duckdb.connect()
    con.register("documents", table.select("doc_id", "text", "source").toPandas())
    got = got.drop(columns="host")
    want = con.sql(queries.QUALITY_SQL).df()[list(got.columns)].sort_values("doc_id").reset_index(drop=True)
    assert (got == want).all().all()

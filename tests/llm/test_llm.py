"""Training-data operators against brute force, and the defined cases of each."""

import hashlib
import itertools
import math
import os
import random
import re
import tracemalloc
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from dialoom.llm import chat, common, decontaminate, licenses, minhash, mixing, pii, quality, queries, repeats, toxicity, urls

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def words(text):
    return re.findall(r"[^\x20\x09-\x0D]+", text or "")


def docs(spark, rows, extra=""):
    """Rows of (doc_id, text[, lang, source]); ``extra`` adds columns that clash with names inside the operators."""
    full = [(i, t, *(more or ("en", "s")), len(t or "")) for i, t, *more in rows]
    made = spark.createDataFrame(full, SCHEMA)
    for name in extra.split():
        made = made.withColumn(name, F.lit("x"))
    return made


def corpus(seed, n, size=60):
    rng = random.Random(seed)
    vocabulary = [f"w{rng.randrange(10**6)}" for _ in range(300)]
    return [" ".join(rng.choices(vocabulary, k=rng.randint(5, size))) for _ in range(n)], rng


CLASHES = "size key seed rank rule doc n comp start kept _x"
ODD = [(1, None), (2, ""), (3, " \n\t "), (4, "a"), (4, "a"), (None, "some text without an id"), (5, "long word " + "x" * 200_000)]


@pytest.fixture(scope="module")
def results(spark):
    """Digests of odd rows with clashing columns, by operator."""
    odd = docs(spark, ODD, CLASHES)
    bench = spark.createDataFrame([(1, None), (2, ""), (3, "too short")], "item_id long, text string")
    labels = spark.createDataFrame([(4, 1), (None, 0), (1, None)], "doc_id long, toxic int")
    return {
        "quality": quality.quality_digest(odd).collect(), "pii": pii.pii_digest(odd).collect(), "mix": mixing.mix_digest(odd).collect(), "near": minhash.near_duplicates(odd).collect(), "licenses": licenses.scan_licenses(odd).collect(),
        "repeats": repeats.remove_repeats(odd).collect(), "leaks": decontaminate.overlap_digest(odd, bench).collect(), "toxicity": toxicity.toxicity_digest(odd, labels).collect(),
    }


def test_odd_rows(results):
    for name, rows in results.items():
        assert len(rows) == (0 if name == "leaks" else len(ODD)), name
    near = [r for r in results["near"] if r.doc_id == 4]
    assert [(r.component_id, r.kept) for r in near] == [(4, True)] * 2
    assert [(r.component_id, r.kept) for r in results["near"] if r.doc_id is None] == [(None, True)]
    assert all(r.n_removed == 0 for r in results["repeats"] if r.doc_id != 5)
    assert {r["size"] for r in results["mix"] if r.doc_id in (1, 2, 3)} == {0}


def test_empty_tables(spark):
    none, bench = docs(spark, []), spark.createDataFrame([], "item_id long, text string")
    labels, pages, turns = (spark.createDataFrame([], s) for s in ("doc_id long, toxic int", "page_id long, url string", "conv_id long, turn long, role string, text string"))
    for made in (
        quality.quality_digest(none), pii.pii_digest(none), mixing.mix_digest(none), minhash.near_duplicates(none), licenses.scan_licenses(none), repeats.remove_repeats(none),
        decontaminate.overlap_digest(none, bench), toxicity.toxicity_digest(none, labels), urls.url_verdicts(pages), chat.format_chats(turns), minhash.near_dedup(none), decontaminate.decontaminate(none, bench),
    ):
        assert made.count() == 0


# --- 1 chat


def cheapest(roles, config):
    """Least cost over all output roles, by enumeration."""
    best = float("inf")
    for outs in itertools.product((1, 2, 3), repeat=len(roles)):
        state, cost = 0, 0.0
        for role, out in zip(roles, outs, strict=True):
            known = role in chat.ROLES
            cost += (0 if known and chat.ROLES.index(role) + 1 == out else config.relabel if known else config.unknown)
            way = chat.way(state, out)
            options = ([config.merge] if out == state else []) + ([config.insert * len(way)] if way is not None else [])
            cost += min(options, default=float("inf"))
            state = out
        best = min(best, cost + chat.closing(state, config)[0])
    return best


def test_chat_cost_is_least():
    rng, config = random.Random(3), chat.ChatConfig()
    tables = chat.Tables(config)
    for _ in range(300):
        roles = [rng.choice(["system", "user", "assistant", None, "bot"]) for _ in range(rng.randint(0, 6))]
        assert chat.repair(roles, tables)[0] == cheapest(roles, config)


def test_chat_chunks_change_nothing(spark):
    rng = random.Random(4)
    rows = [(c, t, rng.choice(["system", "user", "assistant", None, "bot"]), f"t{t}") for c in (1, 2, None) for t in range(40)] + [(3, None, "user", None), (3, 0, "user", "a")]
    turns = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    def whole(config):
        by = defaultdict(list)
        for r in chat.format_chats(turns, config).orderBy("conv_id", "chunk", "seq").collect():
            by[r.conv_id].append(r)
        return {k: (sum(r.cost for r in v), "".join(r.rendered for r in v)) for k, v in by.items()}
    small, large = whole(chat.ChatConfig(chunk=4)), whole(chat.ChatConfig())
    assert {k: v[0] for k, v in small.items()} == {k: v[0] for k, v in large.items()}
    for _, text in small.values():
        seq = re.findall(r"<\|(system|user|assistant)\|>", text)
        assert text.count("<|end|>") == len(seq) and seq[-1] == "assistant"
        body = seq[1:] if seq[0] == "system" else seq
        assert body == ["user", "assistant"] * (len(body) // 2)


# --- 2 toxicity


def test_segments_equal_brute_force():
    rng = random.Random(5)
    for _ in range(200):
        scores = [rng.choice([-1.0, -1.0, -1.0, rng.uniform(-0.5, 3)]) for _ in range(rng.randint(1, 25))]

        def best(a, b):
            """The best segment, then the best ones left and right of it."""
            top = max(((sum(scores[i:j]), i, j) for i in range(a, b) for j in range(i + 1, b + 1)), default=(0, 0, 0))
            return [] if top[0] <= 0 else [*best(a, top[1]), (top[1], top[2] - 1), *best(top[2], b)]

        got = toxicity.segments([(i, s) for i, s in enumerate(scores) if s != -1.0], -1.0)
        assert [(a, b) for a, b, _ in got] == best(0, len(scores))


def test_toxicity_decay_and_constant():
    """The root is finite whatever the weights, and the constant is recovered from maxima drawn by the law."""
    for scores, weights in (([5, 6, -0.1], [0.5, 0.5, 1000]), ([5, 6, -0.1], [1, 0, 1000]), ([0.2, -0.1], [300, 1000]), ([12.0, -0.05], [1e-3, 1e9])):
        s, w = toxicity.np.array(scores), toxicity.np.array(weights, dtype=float)
        root = toxicity._decay(s, w)
        assert (w / w.sum() * toxicity.np.exp(root * s)).sum() == pytest.approx(1, abs=1e-9) or w[s.argmax()] == 0
    rng = toxicity.np.random.default_rng(3)
    n = rng.integers(50, 500, 20_000).astype(float)
    best = toxicity.np.log(0.02 * n) - toxicity.np.log(-toxicity.np.log(rng.random(20_000)))
    assert toxicity._constant(toxicity.np.where(best > 0.5, best, 0), n, 0.5) == pytest.approx(0.02, rel=0.05)


def test_toxicity_held_out(spark):
    rng = random.Random(6)
    plain = [f"p{i}" for i in range(200)]
    rows, labels = [], []
    for i in range(400):
        text = rng.choices(plain, k=80)
        toxic = i % 4 == 0
        if toxic:
            text[10:13] = rng.choices(["vile", "awful", "nastyone", "nastytwo"], k=3)
        rows.append((i, " ".join(text)))
        labels.append((i, int(toxic)))
    got = toxicity.toxicity_digest(docs(spark, rows), spark.createDataFrame(labels, "doc_id long, toxic int")).collect()
    out = [r for r in got if r.held_out]
    assert out and sum(r.predicted == int(r.doc_id % 4 == 0) for r in out) >= 0.98 * len(out)


# --- 3 PII

BASE = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def luhn(d):
    return sum((x if i % 2 == 0 else x * 2 - 9 * (x > 4)) for i, x in enumerate(int(c) for c in reversed(d))) % 10 == 0


def base_spans(text):
    digits = lambda m: re.sub("[^0-9]", "", m)
    fine = {"email": lambda m: True, "ip": lambda m: all(int(p) <= 255 for p in m.split(".")), "card": lambda m: 16 <= len(digits(m)) <= 19 and luhn(digits(m)), "phone": lambda m: 8 <= len(digits(m)) <= 15}
    return ",".join(f"{k}:{m.start()}:{m.end()}" for k, p in BASE.items() for m in re.finditer(p, text) if fine[k](m.group()))


def test_pii_equals_plain_patterns(spark):
    rng = random.Random(8)
    parts = ["a.b@c.d", "._x@e.f", "@", "a@b", "1.2.3.4", "300.1.1.1", ".5.6", "4111 1111 1111 1111", "4111-1111-1111-1112", "00001.2.3.255", "+1 (555) 010-2233", "+", "12", " ", "-", "é", "\U0001f600", "x", ".", "\n", "+49 30 1"]
    texts = ["".join(rng.choices(parts, k=rng.randint(1, 14))) for _ in range(400)] + ["a@b" + ".c" * 20_000, "1" * 50_000, "a" * 300_000, None, ""]
    got = {r.doc_id: r for r in pii.pii_digest(docs(spark, list(enumerate(texts)))).collect()}
    for i, t in enumerate(texts):
        want = base_spans(t or "")
        assert got[i].base_sha256 == hashlib.sha256(want.encode()).hexdigest(), (t or "")[:80]
        assert set(filter(None, want.split(","))) <= set(got[i].spans.split(","))


def test_pii_more_kinds_and_redaction(spark):
    text = "Bank IBAN GB82 WEST 1234 5698 7654 32, not GB82 WEST 1234 5698 7654 33. token = \"" + "a1" * 12 + "\" mail me@x.org"
    r = pii.pii_redact(docs(spark, [(1, text), (2, None), (3, "nothing")])).orderBy("doc_id").collect()
    assert r[0].text == "Bank IBAN [IBAN], not GB82 WEST 1234 5698 7654 33. token = \"[SECRET]\" mail [EMAIL]"
    assert r[0].n_chars == len(r[0].text) and r[1].text is None and r[2].text == "nothing"


def accounts(text):
    """Leftmost account numbers: of all parts from a start that pass, that of the country's length, or else the longest."""
    out, last = [], 0
    for m in re.finditer("(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}", text):
        if m.start() >= last:
            fits = {}
            for end in range(m.start() + 15, min(len(text), m.start() + 70) + 1):
                part, bare = text[m.start() : end], text[m.start() : end].replace(" ", "")
                if re.fullmatch("[A-Z]{2}[0-9]{2}( ?[A-Z0-9]){11,30}", part) and not re.match("[A-Za-z0-9]", text[end:]) and int("".join(str(int(c, 36)) for c in bare[4:] + bare[:4])) % 97 == 1:
                    fits[len(bare)] = end
            own = {"DE": 22, "GB": 22, "NO": 15, "FR": 27}.get(text[m.start() : m.start() + 2])
            if fits:
                last = fits.get(own, fits[max(fits)])
                out.append(f"iban:{m.start()}:{last}")
    return out


def test_pii_account_numbers_before_words_and_numbers(spark):
    iban = "DE89 3704 0044 0532 0130 00"
    bare = iban.replace(" ", "")
    fixed = [f"{bare} Please", f"{iban} Bank", "GB82 WEST 1234 5698 7654 32 AND more", f"{iban} 12 euros", f"{iban} {iban}", f"{bare} {bare} {bare}", f"AB12 {iban} X", f"{bare}X", f"{iban}x", f"{bare}\u00e9", "NO93 8601 1117 947 50 EUR"]
    rng = random.Random(20)
    parts = [iban, bare, "GB82 WEST 1234 5698 7654 32", "NO9386011117947", "FR14 2004 1010 0505 0001 3M02 606", "XX12", "QQ", " ", " ", " ", " A", "12", "Please", "AND", ",", "\U0001f600", "z"]
    texts = fixed + ["".join(rng.choices(parts, k=rng.randint(1, 12))) for _ in range(300)] + ["AB12 " * 500, "AB12" * 20_000]
    want = [accounts(t) for t in texts]
    assert all(want[i] for i in (0, 1, 2, 3, 4, 5, 6, 9, 10)) and len(want[5]) == 3
    got = {r.doc_id: [x for x in r.spans.split(",") if x.startswith("iban")] for r in pii.pii_digest(docs(spark, list(enumerate(texts)))).collect()}
    for i, t in enumerate(texts):
        assert got[i] == want[i], t[:90]


def test_pii_long_secrets_and_their_ends(spark):
    secret = "a1B2" * 75
    rows = [(i, f"api_key={s}{end}") for i, (s, end) in enumerate([(secret, ""), (secret, "\n"), *((secret[:24], e) for e in (".", ", x", ";", ")", "]", "}", ":", "!", "?", "`", "\t", "\r\n", "<b>"))])]
    got = {r.doc_id: r.text for r in pii.pii_redact(docs(spark, rows)).collect()}
    assert got == {i: "api_key=[SECRET]" + t[8:].lstrip("a1B2") for i, t in rows}


# --- 4 urls


def test_url_cascade_is_exact(spark):
    rng = random.Random(9)
    hosts = [f"h{i}.example.{e}" for i in range(400) for e in ("com", "net")]
    listed = tuple(rng.sample(hosts, 300))
    rows = [(i, f"https://{rng.choice(['', 'www.', 'A.'])}{h}{rng.choice(['', '/', '/en/x', '/de/', '?q', '/en'])}") for i, h in enumerate(hosts * 2)] + [(9001, None), (9002, "no scheme"), (9003, "http://"), (9003, "http://")]
    config = urls.UrlConfig(hosts=listed)
    rules = {h + p: v for h, p, v in config.rules}
    for r in urls.url_verdicts(spark.createDataFrame(rows, "page_id long, url string"), config).collect():
        fits = [(len(h + p), h + p) for h, p, _ in config.rules if (r.host == h or r.host.endswith("." + h)) and r.path.startswith(p)]
        rule = max(fits)[1] if fits else None
        assert r.rule == rule
        own = any(r.host == h or r.host.endswith("." + h) for h in listed)
        assert r.verdict == (rules[rule] if rule else "block" if own else "allow")
    assert {r.host for r in urls.url_verdicts(spark.createDataFrame([(1, "x://A.B?c"), (2, "x://a.b#")], "page_id long, url string")).collect()} == {"a.b"}


# --- 5 licenses


def test_license_words_and_labels(spark):
    rows = [(1, "All Rights-Reserved. cc  BY, é all rights reserved"), (2, "This is the GNU General Public License, version 3."), (3, None), (4, "licensed under the apache license, version 2.0 and cc by-sa 4.0")]
    got = {r.doc_id: r for r in licenses.scan_licenses(docs(spark, rows)).collect()}
    assert (got[1].n_words, got[1].n_base, got[1].first_word, got[1].last_word, got[1].base_labels) == (9, 3, 0, 6, "cc-by,reserved")
    assert got[2].base_labels == "gpl" and "gpl-3.0" in got[2].labels.split(",") and got[2].score >= 0.8
    assert (got[3].n_words, got[3].first_word, got[3].labels, got[3].score) == (0, None, "", 0.0)
    assert {"apache-2.0", "cc-by", "cc-by-sa-4.0"} <= set(got[4].labels.split(","))


def example(pattern):
    """Two texts that a signature's pattern matches: with and without its optional parts."""
    import re._parser as parser

    def write(parsed, least):
        out = ""
        for op, arg in parsed:
            op = str(op)
            if op == "LITERAL":
                out += chr(arg)
            elif op == "NOT_LITERAL" or op == "ANY":
                out += "z"
            elif op == "IN":
                kind, value = str(arg[0][0]), arg[0][1]
                out += chr(value) if kind == "LITERAL" else chr(value[0]) if kind == "RANGE" else {"CATEGORY_DIGIT": "2", "CATEGORY_WORD": "w"}[str(value)]
            elif op == "BRANCH":
                out += write(arg[1][0 if least else -1], least)
            elif op == "SUBPATTERN":
                out += write(arg[3], least)
            elif op in ("MAX_REPEAT", "MIN_REPEAT"):
                out += write(arg[2], least) * (arg[0] if least else max(arg[0], min(arg[1], 1)))
        return out

    parsed = parser.parse(pattern)
    return write(parsed, True), write(parsed, False)


def test_license_signatures_match_and_have_their_keyword():
    made = licenses.rules()
    assert len(made) > 250 and len({r.pattern for r in made}) == len(made)
    for r in made:
        for text in example(r.pattern):
            text = " ".join(text.split())
            assert re.search(r.pattern, text), (r, text)
            assert any(k in text for k in r.keyword.split("~")), (r, text)


def labels(text):
    """Base and method labels of a text, by plain search: all rules, no keywords, suppression pair by pair."""
    low = " ".join((text or "").lower().split())
    found = [(r.priority, m.start(), m.end(), m.group(1) if r.label == licenses.TAG else r.label) for r in licenses.rules() for m in re.finditer(r.pattern, low)]
    stay = []
    for x in sorted(set(found), key=lambda x: (x[0], x[1] - x[2], x[1], x[3])):
        if not any(y[1] <= x[1] and x[2] <= y[2] for y in stay):
            stay.append(x)
    w = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (text or "").translate(LOWER))
    places = [(i, label) for phrase, label in licenses.BASE for i in range(len(w)) if w[i : i + len(phrase.split())] == phrase.split()]
    return len(w), len(places), min(places, default=(None,))[0], max(places, default=(None,))[0], ",".join(sorted({x[1] for x in places})), ",".join(sorted({x[1] for x in places} | {x[3] for x in stay}))


def test_licenses_equal_brute_force(spark):
    rng = random.Random(21)
    made = [t for r in licenses.rules() for t in example(r.pattern)] + ["all rights reserved", "CC by", "GNU General Public License", "lorem ipsum", "an account to submit", "\u0130 x", "é"]
    texts = [" ".join(x.upper() if rng.random() < 0.3 else x for x in rng.choices(made, k=rng.randint(1, 6))) for _ in range(500)] + [None, "", "word " * 30_000]
    for r in licenses.scan_licenses(docs(spark, list(enumerate(texts)))).collect():
        assert (r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels, r.labels) == labels(texts[r.doc_id]), texts[r.doc_id][:200]


def test_license_suppression_equals_brute_force():
    rng = random.Random(10)
    for _ in range(300):
        found = [(rng.randint(0, 3), a, a + rng.randint(1, 9), rng.choice("ab")) for a in (rng.randint(0, 20) for _ in range(rng.randint(0, 12)))]
        order, stay = sorted(found, key=lambda x: (x[0], x[1] - x[2], x[1], x[3])), []
        for x in order:
            if not any(y[1] <= x[1] and x[2] <= y[2] for y in stay):
                stay.append(x)
        assert sorted(licenses.suppressed(found)) == sorted(stay)


# --- 6 mixing


def targets(sizes, weights=(5, 2, 1), most=3):
    names = sorted((s for s in sizes if s is not None)) + [s for s in sizes if s is None]
    w = {s: weights[i % len(weights)] for i, s in enumerate(names)}
    capped, total = set(), sum(sizes.values())
    while True:
        rest = total - sum(most * sizes[s] for s in capped)
        left = sum(w[s] for s in names if s not in capped)
        t = {s: most * sizes[s] if s in capped else rest * w[s] / left for s in names}
        over = {s for s in names if t[s] > most * sizes[s]}
        if not over:
            return t
        capped |= over


def test_mix(spark):
    texts, rng = corpus(11, 600)
    sources = ["a", "b", "c", "é", None, "tiny"]
    rows = [(i, t, "en", "tiny" if i < 3 else sources[min(4, int(rng.expovariate(1)))]) for i, t in enumerate(texts)]
    got = mixing.mix_digest(docs(spark, rows)).collect()
    assert sorted(got) == sorted(mixing.mix_digest(docs(spark, rows).repartition(7)).collect())
    size, taken, by = Counter(), Counter(), {r[0]: r[3] for r in rows}
    for r in got:
        assert r["size"] == len(words(texts[r.doc_id])) and 0 <= r.taken <= 3 * r["size"]
        size[by[r.doc_id]] += r["size"]
        taken[by[r.doc_id]] += r.taken
    want = targets(size)
    for r in got:
        assert r.source_size == size[by[r.doc_id]] and r.target == pytest.approx(want[by[r.doc_id]])
    assert all(abs(taken[s] - want[s]) <= 1 for s in size)


# --- 7 near duplicates


def shingles(text, k=5):
    w = words((text or "").translate(LOWER))
    return frozenset(tuple(w[i : i + k]) for i in range(len(w) - k + 1)) if len(w) >= k else frozenset([tuple(w)] if w else [])


def components(sets, percent=85):
    parent = {i: i for i in sets}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in itertools.combinations(sorted(sets), 2):
        n = len(sets[a] & sets[b])
        if n and 100 * n >= percent * len(sets[a] | sets[b]):
            x, y = find(a), find(b)
            parent[max(x, y)] = min(x, y)
    return {i: find(i) for i in sets}


def near_corpus():
    texts, rng = corpus(12, 60, 200)
    for t in texts[:25]:
        for _ in range(rng.randint(1, 4)):
            w = t.split()
            for _ in range(rng.randint(0, 3)):
                w[rng.randrange(len(w))] = f"new{rng.randrange(999)}"
            texts.append(" ".join(w))
    chain = " ".join(f"c{i}" for i in range(150)).split()
    for step in range(30):  # neighbours are linked, ends are far apart
        chain[step * 5] = f"d{step}"
        texts.append(" ".join(chain))
    return texts + ["One TWO three", "one two  three", "", texts[0].upper()]


@pytest.mark.parametrize("config", [{}, {"leaders": (), "block": 7, "reach": 11}, {"leaders": (1,), "small": 3, "block": 2, "block_shingles": 300, "last_links": -1}, {"leaders": (1, 1), "small": 5, "reach": 3}])
def test_near_duplicates_equal_brute_force(spark, config):
    config = minhash.NearConfig(**config)
    texts = near_corpus()
    want = components({i: shingles(t) for i, t in enumerate(texts)})
    rows = list(enumerate(texts))
    random.Random(1).shuffle(rows)
    got = {r.doc_id: r for r in minhash.near_duplicates(docs(spark, rows), config).collect()}
    assert {i: r.component_id for i, r in got.items()} == want
    assert all(r.n_shingles == len(shingles(texts[i])) and r.kept == (want[i] == i) for i, r in got.items())


def test_near_copies_in_a_block_are_compared_in_bounded_memory(monkeypatch):
    rng = np.random.default_rng(1)
    shared, n = rng.integers(-(2**62), 2**62, 500), 400
    sets = [np.unique(np.concatenate((shared[: 500 - i % 90], rng.integers(-(2**62), 2**62, i % 90)))) for i in range(n)]
    sides = np.where(np.arange(n) < 256, 0, 1)
    columns = [pa.array(np.zeros(n, np.int64)), pa.array(np.zeros(n, np.int64)), pa.array(sides.astype(np.int32)), pa.array(np.arange(n)), pa.array(np.arange(n)), pa.array([x.tolist() for x in sets], pa.list_(pa.int64()))]
    batch = pa.RecordBatch.from_arrays(columns, names=["k1", "k2", "side", "doc", "comp", "shingles"])
    # every pair between the sides, so that no link is left out because others join its components
    index = minhash.Index(list(range(256)), list(range(256)), sets[:256], 85)
    monkeypatch.setattr(index, "find", lambda x: x)
    near = [(i, j) for i in range(256) for j in range(256, n) if 100 * (k := len(np.intersect1d(sets[i], sets[j]))) >= 85 * (len(sets[i]) + len(sets[j]) - k)]
    assert 0 < len(near) < 256 * (n - 256) and sorted(index.links(list(range(256, n)), list(range(256, n)), sets[256:])) == near
    tracemalloc.start()
    found = [tuple(r.values()) for out in minhash._against(iter([batch]), minhash.NearConfig()) for r in out.to_pylist()]
    most = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert set(found) <= set(near)
    assert most < 100e6  # for about 15 million places in the index


def test_lists_are_joined_without_a_task_that_gets_a_net(spark, monkeypatch):
    lists = {t: set(range(t % 4, 40 + t % 4)) for t in range(20)}  # one net, cheaper as one list
    lists |= {100 + t: {1000 + 9 * t + i for i in range(10)} for t in range(20)}  # a chain: one net, cheaper apart
    lists |= {200: set(range(2000, 2010)), 201: {5000}}
    rows = [(t, d, d % 7, bytes([d % 256]), 50, 1) for t, members in lists.items() for d in members]
    labeled = spark.createDataFrame(rows, "tok long, doc long, comp long, low binary, size long, own long")
    scratch, deals = common.Scratch(spark, "joined"), []

    def walk(node):
        if node.nodeName() == "Exchange":
            deals.append((node.outputPartitioning().toString(), node.output().mkString(",")))
        for i in range(node.children().size()):
            walk(node.children().apply(i))

    def keep(frame, name, made=scratch.keep):
        if name == "joined":
            walk(frame._jdf.queryExecution().executedPlan())
        return made(frame, name)

    monkeypatch.setattr(scratch, "keep", keep)
    before = {k: spark.conf.get(k) for k in ("spark.sql.adaptive.enabled", "spark.sql.autoBroadcastJoinThreshold")}
    try:
        spark.conf.set("spark.sql.adaptive.enabled", "false")
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
        got = defaultdict(list)
        for r in minhash._joined(labeled, minhash.NearConfig(), scratch).collect():
            got[r.tok].append(r.doc)
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
    want = [sorted(range(43)), *[sorted(v) for t, v in lists.items() if t >= 100]]
    assert sorted(sorted(x) for x in got.values()) == sorted(want)
    assert any("hashpartitioning(net" in by for by, _ in deals)
    assert not any("hashpartitioning(net" in by and "low#" in columns for by, columns in deals)


def test_near_dedup_keeps_one_row_of_each_group(spark):
    texts = near_corpus()
    rows, want = list(enumerate(texts)), components({i: shingles(t) for i, t in enumerate(texts)})
    assert sorted(r.doc_id for r in minhash.near_dedup(docs(spark, rows, CLASHES)).collect()) == sorted(set(want.values()))
    twice = [(1, "a b"), (1, "a b"), (2, "c"), (None, "d"), (None, "d")]
    for order in (1, 7):
        assert sorted((r.doc_id or 0, r.text) for r in minhash.near_dedup(docs(spark, twice, CLASHES).repartition(order)).collect()) == [(0, "d"), (0, "d"), (1, "a b"), (2, "c")]


def test_near_words_of_regular_structure_stay_apart(spark):
    word = "a"
    while len(word) < 4096:
        word += word.translate(str.maketrans("ab", "ba"))
        if len(word) >= 1024:
            rows = [(1, word), (2, word.translate(str.maketrans("ab", "ba"))), (3, "x " + word), (4, "x " + word.translate(str.maketrans("ab", "ba")))]
            assert [r.component_id for r in minhash.near_duplicates(docs(spark, rows)).orderBy("doc_id").collect()] == [1, 2, 3, 4]


# --- 8 repeats


def removed(rows, length=100):
    seen, out = set(), {}
    for i, t in sorted(rows):
        b = (t or "").encode()
        gone = bytearray(len(b))
        for k in range(len(b) - length + 1):
            s = b[k : k + length]
            if s in seen:
                gone[k : k + length] = b"\1" * length
            seen.add(s)
        kept = bytes(x for x, g in zip(b, gone, strict=True) if not g)
        spans = sum(1 for k in range(len(b)) if gone[k] and (k == 0 or not gone[k - 1]))
        out[i] = (len(b), sum(gone), spans, hashlib.sha256(kept).hexdigest())
    return out


@pytest.mark.parametrize("config", [{}, {"contexts": 1}, {"hot": 1, "even": 0.0, "share": 1.0}, {"hot": 2, "even": 0.0, "share": 0.5, "combine": 50}, {"combine": 1, "gram": 8}])
def test_repeats_equal_brute_force(spark, config):
    texts, rng = corpus(13, 40, 80)
    passages = [" ".join(f"é{rng.randrange(99)}" for _ in range(40)) for _ in range(4)]
    made = []
    for t in texts:
        k = rng.randrange(len(t))
        p = rng.choice(passages)
        made.append(t[:k] + p[rng.randrange(30) :] + t[k:] if rng.random() < 0.7 else t)
    zeros = ["\0" * n + "q" * (150 - n) + "\0" * 90 for n in (0, 1, 60, 99, 149)]  # padding must not look like these
    made += [*zeros, made[3], made[3] + made[5], "ab" * 400, "x" * 99, "x" * 100, "x" * 250, None, "", passages[0] * 3]
    rows = list(enumerate(made))
    got = {r.doc_id: tuple(r)[1:5] for r in repeats.remove_repeats(docs(spark, rows).repartition(5), repeats.RepeatConfig(**config)).collect()}
    assert got == removed(rows)


def test_repeats_hold_and_write_little_at_once(spark, monkeypatch):
    """Arrow batches are bounded, contexts leave in pieces, and they are written only if some gram is crowded."""
    kept, keep, key = [], common.Scratch.keep, "spark.sql.execution.arrow.maxBytesPerBatch"
    monkeypatch.setattr(common.Scratch, "keep", lambda self, frame, name: (kept.append(name), keep(self, frame, name))[1])
    texts, _ = corpus(18, 12, 60)
    rows = [(i, f"{i} {t} {texts[-1 - i]} {i} {texts[i % 5]}") for i, t in enumerate(texts)]
    for config, written in (({}, False), ({"contexts": 2}, True)):
        spark.conf.unset(key)
        kept.clear()
        got = repeats.remove_repeats(docs(spark, rows * 2).repartition(3), repeats.RepeatConfig(**config)).collect()  # rows that share an id don't repeat each other
        assert len(got) == 2 * len(rows) and {r.doc_id: tuple(r)[1:5] for r in got} == removed(rows) and ("cut" in kept) == written
        assert spark._jsparkSession.sessionState().conf().arrowMaxBytesPerBatch() <= 4 << 20
    edges = [[{"kind": 0, "g": k, "start": k % 900, "size": (5 << 8) | 1} for k in range(1000)] for _ in range(50)]
    batch = pa.RecordBatch.from_arrays([pa.array(range(50)), pa.array(["x" * 999] * 50), pa.array(edges, pa.list_(pa.struct([("kind", pa.int32()), *((n, pa.int64()) for n in ("g", "start", "size"))])))], names=["doc", "text", "edges"])
    tracemalloc.start()
    sizes = [(b.num_rows, b.column(5).type) for b in repeats._cut(iter([batch]), repeats.RepeatConfig())]
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert sizes == [(10_000, pa.binary())] * 5 and peak < 50_000 * 200


def test_repeats_of_long_texts():
    rng = random.Random(14)
    half = bytes(rng.choices(b"abcdef ", k=3000))
    old, repeats._PIECE, repeats._BLOCK = (repeats._PIECE, repeats._BLOCK), 700, 900
    try:
        found = [x for b in repeats.pieces([half * 2, half], 100) for x in zip(*repeats.contexts(b, repeats.RepeatConfig()), strict=True)]
    finally:
        repeats._PIECE, repeats._BLOCK = old
    windows = sorted((n, s + k) for n, s, m, *_ in found for k in range(m))
    assert windows == [(0, k) for k in range(5901)] + [(1, k) for k in range(2901)]


# --- 9 decontamination


def leaks(texts, items, window=14, share=0.8, exact=7):
    """(document, item) pairs by exhaustive comparison of all alignments."""
    cut = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (t or "").lower())
    out = set()
    for i, item in enumerate(map(cut, items)):
        need = len(item) if len(item) < exact else math.ceil(round(share * min(window, len(item)), 9))
        for d, doc in enumerate(map(cut, texts)) if item else ():
            for shift in range(-len(item) + 1, len(doc)):
                same = [0 <= shift + k < len(doc) and doc[shift + k] == w for k, w in enumerate(item)]
                if max(sum(same[k : k + window]) for k in range(max(1, len(item) - window + 1))) >= need:
                    out.add((d, i))
    return out


def test_decontamination_equals_exhaustive_search(spark):
    """Items of every length from 1 to 30 tokens, planted with up to one substitution more than is tolerated, at all places."""
    texts, rng = corpus(15, 260, 60)
    items = [" ".join(f"b{n}x{k}" for k in range(n)) for n in [*range(1, 16), 20, 30]] + [None, ""]
    for i, t in enumerate(texts[:240]):
        w = items[i % 17].split()
        for k in rng.sample(range(len(w)), min(len(w), i // 17 % 5)):
            w[k] = "sub"
        texts[i] = t + " " + " ".join(w).upper() + (". " + t[:20] if i % 2 else "")
    texts += [items[i] for i in range(17)] + [None, ""]
    bench = spark.createDataFrame(list(enumerate(items)), "item_id long, text string")
    want = leaks(texts, items)
    got = {(r.doc_id, r.item_id) for r in decontaminate.overlap_digest(docs(spark, list(enumerate(texts))), bench).collect()}
    assert got == want and len(want) > 100
    rows = docs(spark, list(enumerate(texts)), CLASHES + " _digest _row")
    left = decontaminate.decontaminate(rows, bench)
    assert left.columns == rows.columns and {r._digest for r in left.collect()} == {"x"}
    assert sorted(r.doc_id for r in left.collect()) == [i for i in range(len(texts)) if i not in {d for d, _ in want}]


# --- 10 quality


def counts(text):
    w = words(text)
    lines = [x for x in (text or "").split("\n") if words(x)]
    seen = Counter(tuple(w[i : i + 3]) for i in range(len(w) - 2))
    hit = {i + k for i in range(len(w) - 2) if seen[tuple(w[i : i + 3])] > 1 for k in range(3)}
    return len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in text or ""), len(lines) - len(set(lines)), len(hit)


def test_quality_counts(spark):
    rng = random.Random(16)
    texts = ["\n".join(" ".join(rng.choices("a b c dd é# $x".split(), k=rng.randint(0, 9))) for _ in range(rng.randint(1, 12))) for _ in range(150)] + [None, "", "a b c " * 3000, "\n\n \x0b", "x y z w"]
    got = {r.doc_id: r for r in quality.quality_digest(docs(spark, list(enumerate(texts)))).collect()}
    for i, t in enumerate(texts):
        r, want = got[i], counts(t)
        assert tuple(r)[1:6] == want
        assert r.base_failed == (want[0] < 50 or 100 * want[4] > 50 * want[0]) and not (r.base_failed and r.kept)


def test_quality_thresholds_follow_the_group(spark):
    texts, _ = corpus(17, 300, 120)
    rows = [(i, t + " word" * 0, "en", None if i % 2 else "s") for i, t in enumerate(texts) if len(t.split()) >= 50]
    rows += [(9000, " ".join(f"{w}###" for w in texts[0].split() * 9), "en", None), (9001, " ".join(texts[1].upper().split() * 1 + [f"Q{i}" for i in range(60)]), "en", "s")]
    got = {r.doc_id: r.kept for r in quality.quality_digest(docs(spark, rows)).collect()}
    assert not got[9000] and not got[9001] and all(v for k, v in got.items() if k < 9000)


# --- pipeline


def test_pipeline(spark):
    import corpus_pipeline

    sf = "/root/testdata/sf0.001"
    if not os.path.isdir(sf):
        pytest.skip("no test tables")
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality_rules", "near_duplicates", "decontamination", "pii", "mixing"]
    base = common.read_table(spark, sf, "documents")
    bench = common.read_table(spark, sf, "benchmark")
    kept = {r.doc_id: r for r in quality.quality_digest(base).collect() if r.kept}
    texts = {r.doc_id: r.text for r in base.collect() if r.doc_id in kept}
    comp = components({i: shingles(t) for i, t in texts.items()})
    texts = {i: t for i, t in texts.items() if comp[i] == i}
    items = [r.text for r in bench.collect()]
    texts = {i: t for i, t in texts.items() if not any(x in t for x in items)}
    got = corpus_pipeline.run(spark, sf)
    assert got.columns[:5] == base.columns
    rows = got.collect()
    assert {r.doc_id for r in rows} <= set(texts) and all(r.mix_taken > 0 for r in rows)
    size = sum(len(words(t)) for t in texts.values())
    assert abs(sum(r.mix_taken for r in rows) - size) <= 0.02 * size + 20


def test_pipeline_near_stage_links_from_80_percent(spark):
    import corpus_pipeline

    texts = near_corpus()
    for n in (48, 49, 55):  # one other word in the middle: similarities 39/49, 40/50 and 46/56
        w = [f"n{n}x{i}" for i in range(n)]
        texts += [" ".join(w), " ".join([*w[:20], "other", *w[21:]])]
    rows = list(enumerate(texts))
    comp = components({i: shingles(t) for i, t in rows}, 80)
    last = len(texts) - 6
    assert [comp[last + i] - last for i in range(6)] == [0, 1, 2, 2, 4, 4]
    got = corpus_pipeline.near_duplicates(spark, docs(spark, rows), "").collect()
    assert sorted(r.doc_id for r in got) == sorted(set(comp.values()))


def test_registered():
    assert set(queries.oracle_sql()) <= set(queries.queries())
    assert sorted(int(n[2:].split("_")[0]) for n in queries.queries()) == list(range(1, 11))

"""Words, lines, quality rules, language, secrets and the classifier, against plain Python."""

import hashlib
import random
import re
import zlib
from collections import Counter

import numpy as np
import pandas as pd
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from lakeaudit.llm import language_id, line_quality, quality_classifier, secret_links
from lakeaudit.llm import words as W

WORD = re.compile("[^\x20\x09-\x0D]+")
DOCS = "doc_id long, text string, lang string, source string, n_chars long"
TEXTS = ["", None, "one", "a b c d e f g h a b c d e f g h x", "Ünï cödé x y\n\n \nlast\n", "x\r\nx\r\n x\nx", "\n", "# $ | <b> 5&*%\n" * 3, "w " * 5000, "é" * 70_000 + " tail", "a\x00b \x0b c"]


def rows(texts):
    return [(i, t, "en", "s", len(t or "")) for i, t in enumerate(texts)]


def plain_rules(text):
    text = text or ""
    words, lines, seen, dup = WORD.findall(text), text.split("\n"), set(), 0
    for line in lines:
        dup += bool(WORD.search(line)) and line in seen
        seen.add(line)
    runs, covered = Counter(tuple(words[i : i + 8]) for i in range(len(words) - 7)), set()
    for i in range(len(words) - 7):
        if runs[tuple(words[i : i + 8])] > 1:
            covered.update(range(i, i + 8))
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), dup, len(covered), len(words) < 20 or 100 * len(covered) > 30 * len(words)


def test_line_quality_counts(spark):
    r = random.Random(3)
    texts = TEXTS + ["".join(r.choice("ab é\n\t|#.") for _ in range(r.randint(0, 400))) for _ in range(60)]
    got = {x.doc_id: x for x in line_quality.line_quality(spark.createDataFrame(rows(texts), DOCS)).collect()}
    for i, t in enumerate(texts):
        x = got[i]
        assert (x.n_words, x.word_chars, x.n_symbols, x.n_dup_lines, x.n_repeat_words, x.base_failed) == plain_rules(t), repr(t)[:80]
        assert not (x.base_failed and x.kept)


def test_line_quality_verdicts(spark):
    prose = "This is a plain sentence with some words in it. Another one follows here, and a third."
    menu = "\n".join(f"MENU {i} | A{i} | B | C | D | E" for i in range(9))
    loud = "EVERY WORD OF THIS SECOND PART IS LOUD AND LONG SO THAT MOST OF THE TEXT HAS TO GO AWAY NOW"
    texts = [prose + "\nQuite other words make up the line that comes after it.", menu, prose + " We use cookies.\n" + loud]
    got = [x.kept for x in line_quality.line_quality(spark.createDataFrame(rows(texts), DOCS)).orderBy("doc_id").collect()]
    assert got == [True, False, False]


def test_hashes_tell_words_apart():
    texts = pa.array([" ".join(f"w{i} {i}w" for i in range(5000)), "ab ba aab aba baa", "x" * 10_000 + " " + "x" * 9_999 + "y"])
    data, offsets = W.flat(texts)
    w = W.words(data, offsets)
    h = W.word_hash(data, w)
    words = [x for t in texts.to_pylist() for x in WORD.findall(t)]
    assert len(h) == len(words) and len(set(h.tolist())) == len(set(words))
    assert list(W.count_words(pa.array([None, "", " a  b "]).cast(pa.string()))) == [0, 0, 2]


def test_hashes_tell_patterned_words_apart():
    turn, other = [0], [1]
    while len(turn) < 16_384:
        turn, other = turn + [1 - x for x in turn], other + [1 - x for x in other]
    words = ["".join("ab"[x] for x in y[:n]) for y in (turn, other) for n in (8, 4096, 16_384)]
    data, offsets = W.flat(pa.array(words))
    h = W.word_hash(data, W.words(data, offsets))
    assert len(set(h.tolist())) == len(words)
    runs = [h[np.array(x)] for x in (turn[:2048], other[:2048])]
    assert W.window_hash(runs[0], 2048)[0] != W.window_hash(runs[1], 2048)[0]


def plain_base(text):
    text = text or ""
    spans = [(m.start(), 0, m.end()) for m in secret_links.ASSIGN.finditer(text) if len(m[2]) >= 8]
    spans += [(m.start(), 1, m.end()) for m in re.finditer("AKIA[A-Z0-9]+", text) if m.end() - m.start() >= 16]
    spans += [(m.start(), 2, m.end()) for m in re.finditer("[0-9a-f]+", text) if m.end() - m.start() >= 32]
    return ",".join(f"{secret_links.KINDS[k]}:{a}:{b}" for a, k, b in sorted(spans))


def linked(spark, texts, reach=200):
    docs = secret_links.numbered(spark.createDataFrame(rows(texts), DOCS))
    out = {}
    for r in secret_links.secrets(docs, reach=reach).collect():
        out[r.id] = ",".join(f"{secret_links.KINDS[s.kind]}:{s.start}:{s.end}" for s in r.spans)
    return out


def plain_parts(text):
    """The parts as the operator's description states them, each weak part held against each strong one."""
    strong = [(1, m.start(), m.end()) for m in re.finditer("AKIA[A-Z0-9]+", text) if m.end() - m.start() >= 16]
    strong += [(2, m.start(), m.end()) for m in re.finditer("[0-9a-f]+", text) if m.end() - m.start() >= 32]
    strong += [(0, m.start(), m.end()) for m in secret_links.ASSIGN.finditer(text) if len(m[2]) >= 8]
    mixed = lambda x: any(c.isdigit() for c in x) and any("a" <= c <= "z" for c in x) and any("A" <= c <= "Z" for c in x)
    weak = [(3, m.start(), m.end()) for m in re.finditer("[A-Za-z0-9+/_=-]+", text) if len(m[0]) >= 20 and mixed(m[0])]
    weak += [(4, m.start(), m.end()) for m in secret_links.IDENT.finditer(text)] + [(5, m.start(), m.end()) for m in re.finditer(r"""https?://[^\s"'<>]+""", text)]
    found = strong + [x for x in weak if not any(y[1] < x[2] and x[1] < y[2] for y in strong)]
    breaks = [m.end() for m in re.finditer(r"\n[ \t\r]*\n", text)]
    return [(sum(e <= s for e in breaks), k, s, e) for k, s, e in found]


def plain_linked(text, reach=200):
    """All pairs of parts of a scope."""
    found = plain_parts(text or "")
    role = {0: "secret", 1: "identifier", 2: "secret", 3: "secret", 4: "identifier", 5: "endpoint"}
    keep = []
    for i, x in enumerate(found):
        near = {role[y[1]] for j, y in enumerate(found) if j != i and y[0] == x[0] and max(y[2] - x[3], x[2] - y[3]) <= reach}
        ok = x[1] < 3 or x[1] == 3 and near & {"identifier", "endpoint"} or x[1] == 4 and "secret" in near or x[1] == 5 and {"identifier", "secret"} <= near
        if ok:
            keep.append((x[2], x[1], x[3]))
    return ",".join(f"{secret_links.KINDS[k]}:{a}:{b}" for a, k, b in sorted(keep))


def test_secrets_and_links(spark):
    key, hx = "Ab1" + "xY9z" * 6, "0123456789abcdef" * 2
    texts = [
        *TEXTS, f'password = "{key}"', "token: x secret: 12345678", 'password:"token":"abcdefghij"', "AKIA" + "A" * 12, "AKIA" + "A" * 11, hx, hx[:-1], f"é user=bob {key} https://h.example/x", f"user=bob\n\n{key}", f"{key} alone",
        f"user=bob {'z ' * 150}{key}", f"KEY {key} https://h/x", "passſword=12345678", "API_KEY='abc/def+1='", f"login: ann https://h/x {hx}", f"{key} " * 50 + "user=x",
        "https://x.example/?user=bobby&token=abcdefgh1234", f"https://h/?user=ann&key={key}&login=bob&x=1",
    ]
    r = random.Random(21)
    bits = ["user=bob", "token=abcdefgh1", key, hx, "https://h.example/a?b=", "AKIA" + "B" * 14, " ", "\n\n", "&", "words in between ", "z" * 150, "login: x", "secret="]
    texts += ["".join(r.choice(bits) for _ in range(r.randint(1, 14))) for _ in range(300)]
    got = linked(spark, texts)
    for i, t in enumerate(texts):
        base = [s for s in got[i].split(",") if s.split(":")[0] in secret_links.KINDS[: secret_links.BASE]]
        assert ",".join(base) == plain_base(t), repr(t)[:60]
        assert got[i] == plain_linked(t), repr(t)[:60]
    assert "key:" in got[texts.index(f"é user=bob {key} https://h.example/x")] and got[texts.index(f"{key} alone")] == ""


def test_weak_parts_inside_weak_ones(spark):
    import duckdb

    texts = ["https://host/?user=admin&token=abcdefgh12", "see https://h.example/client_id=abc/x?api_key=0123456789 now", "user=bob https://h/?login=ann&a=1&token=abcdefgh12&user=eve", "https://h/?token=abcdefgh12&user=admin"]
    sql = duckdb.connect()
    sql.execute("CREATE TABLE documents (doc_id BIGINT, text VARCHAR)")
    sql.executemany("INSERT INTO documents VALUES (?, ?)", list(enumerate(texts)))
    names = [d[0] for d in sql.execute(secret_links.OP1_SQL).description]
    want = {x[names.index("doc_id")]: x[names.index("spans")] for x in sql.fetchall()}
    got = linked(spark, texts)
    assert got == want and "ident:14:24" in got[0]
    assert secret_links.redact(spark.createDataFrame(rows(texts[:1]), DOCS)).first().text == "https://host/?[REDACTED]&[REDACTED]"


def test_redaction(spark):
    hx = "0123456789abcdef" * 2
    texts = [f'a token = "{hx}" b', "clean", None, f"é{hx}x {hx}"]
    got = [r.text for r in secret_links.redact(spark.createDataFrame(rows(texts), DOCS)).orderBy("doc_id").collect()]
    assert got == ["a [REDACTED]" + '" b', "clean", None, "é[REDACTED]x [REDACTED]"]
    assert secret_links.redact(spark.createDataFrame([], DOCS)).count() == 0


def langs(n=400):
    r = random.Random(5)
    parts = {"en": ["the", "ing", "and", "th", "er", "wh", "tion"], "de": ["der", "sch", "ein", "ung", "ü", "ich", "und"], "fr": ["eau", "é", "les", "tion", "ou", "que", "è"]}
    out = []
    for i in range(n):
        lang = list(parts)[i % 3]
        out.append((i, " ".join("".join(r.choices(parts[lang], k=r.randint(1, 3))) for _ in range(r.randint(8, 60))), lang, "s", 0))
    return out


def test_language_accuracy_and_folds(spark):
    data = langs() + [(1000, None, "en", "s", 0), (1001, "12 34 !!", "de", "s", 0), (1002, "the and", None, "s", 0), (None, "the thing", "en", "s", 0)]
    got = language_id.identify(spark.createDataFrame(data, DOCS)).collect()
    by = {r.doc_id: r for r in got}
    held = [by[i] for i, *_ in data[:400] if by[i].held_out]
    assert len(got) == len(data) and len(held) > 40
    assert all(by[i].held_out == (zlib.crc32(str(i).encode()) % 5 == 0) for i, *_ in data[:400])
    assert np.mean([r.lang_pred == data[r.doc_id][2] for r in held]) > 0.97
    assert by[1000].lang_pred == by[1001].lang_pred == "und" and by[1002].lang_pred == "en" and all(0 <= r.score <= 1 for r in got)
    assert language_id.identify(spark.createDataFrame([(1, "x y", None, "s", 0)], DOCS)).first().lang_pred == "und"


def test_code_lengths_are_a_distribution(spark):
    docs = spark.createDataFrame(langs(60), DOCS)
    model = language_id.train(docs, "doc_id", "text", "lang", 100)
    for context in (b"the", b"  a", b"zqx", bytes([200, 1, 32])):
        runs = np.array([int.from_bytes(context, "big") << 8 | x for x in range(256)], np.uint32)
        assert np.allclose((2.0 ** -language_id.costs(model, runs).astype(np.float64)).sum(0), 1, atol=1e-4)
    texts = pa.array(["the und", "", "eau " * 400_000])
    data, offsets = W.flat(texts)
    bits = language_id.code_lengths(model, data, offsets)
    for row, text in enumerate(texts.to_pylist()[:2]):
        own, total = b"   " + text.encode(), np.zeros(len(model.langs))
        for i in range(3, len(own)):
            total += language_id.costs(model, np.array([int.from_bytes(own[i - 3 : i + 1], "big")], np.uint32))[0]
        assert np.allclose(bits[row], total)
    assert bits[2].argmin() == model.langs.index("fr")


def test_quality_classifier(spark):
    r = random.Random(2)
    word = lambda: "".join(r.choices("etaoinshr", k=r.randint(2, 8)))
    good = lambda: " ".join(" ".join(word() for _ in range(9)) + "." for _ in range(r.randint(2, 20)))
    bad = lambda: " ".join(word() + r.choice(["***", "$$$", "###"]) for _ in range(r.randint(10, 80)))
    data = [(i, good() if i % 3 else bad(), "en", "s", 0) for i in range(600)] + [(900, None, "en", "s", 0), (901, "", "en", "s", 0)]
    docs = spark.createDataFrame(data, DOCS)
    labels = spark.createDataFrame([(i, int(i % 3 > 0), 0) for i in range(600)] + [(None, 1, 0), (5, None, 0)], "doc_id long, quality int, toxic int")
    got = {x.doc_id: x for x in quality_classifier.classify(docs, labels, ["doc_id"]).collect()}
    assert len(got) == 602 and all(0 <= x.score <= 1 and x.predicted == (x.score >= 0.5) for x in got.values())
    held = [x for i, x in got.items() if i < 600 and zlib.crc32(str(i).encode()) % 3 == 1]
    assert all(x.held_out for x in held) and np.mean([x.predicted == int(x.doc_id % 3 > 0) for x in held]) > 0.97
    kept = quality_classifier.keep_good(docs, labels)
    assert kept.columns == docs.columns and {x.doc_id for x in kept.collect()} == {i for i, x in got.items() if x.predicted}
    assert quality_classifier.classify(docs.limit(0), labels, ["doc_id"]).count() == 0 and quality_classifier.keep_good(docs.limit(0), labels.limit(0)).count() == 0
    one = quality_classifier.classify(docs.limit(3), labels.where("quality = 1"), ["doc_id"]).collect()
    assert all(x.predicted == 1 for x in one)


def test_scores_are_the_discriminant(spark):
    """Mahalanobis distances and determinants by plain matrix inverses, from the statistics of the labelled texts."""
    r = random.Random(9)
    texts = [" ".join(r.choice(["good", "Bad!", "x,", "1 2 3", "line\nbreak", "|", "$$", "the", "of"]) for _ in range(r.randint(3, 90))) for _ in range(240)]
    docs = spark.createDataFrame(rows(texts), DOCS).withColumns({"x": F.lit(1), "held_out": F.lit(2), "label": F.lit(3)})
    labels = spark.createDataFrame([(i, int("good" in t[: len(t) // 3]), 0) for i, t in enumerate(texts)], "doc_id long, quality int, toxic int")
    got = {x.doc_id: x.score for x in quality_classifier.classify(docs, labels, ["doc_id"], shrink=0.2, ridge=1e-2).collect()}
    x, y = quality_classifier.features(pa.array(texts)), np.array([int("good" in t[: len(t) // 3]) for t in texts])
    use = np.array([zlib.crc32(str(i).encode()) % 3 != 1 for i in range(len(texts))])
    pooled = sum(np.cov(x[use & (y == k)].T, bias=True) * (use & (y == k)).sum() for k in (0, 1)) / use.sum()
    density = []
    for k in (0, 1):
        own = x[use & (y == k)]
        cov = 0.8 * np.cov(own.T, bias=True) + 0.2 * pooled
        cov = 0.8 * cov + 0.2 * np.diag(np.diag(cov)) + 1e-2 * np.eye(len(cov))
        d = x - own.mean(0)
        density.append(np.log(len(own)) - 0.5 * np.einsum("ij,jk,ik->i", d, np.linalg.inv(cov), d) - 0.5 * np.linalg.slogdet(cov)[1])
    want = 1 / (1 + np.exp(density[0] - density[1]))
    assert np.allclose([got[i] for i in range(len(texts))], want, atol=1e-8)


def test_every_run_counts_for_a_language(spark):
    """Costs by plain Python: recursive escapes with exclusion over the counts of every run, singletons with them."""
    docs = [(i, t, lang, "s", 0) for i, (t, lang) in enumerate([("abcab abd", "p"), ("abce", "p"), ("bcabca!", "q"), ("xyz ab", "q")])]
    model = language_id.train(spark.createDataFrame(docs, DOCS), "doc_id", "text", "lang", 100)
    symbols = sorted({b for _, t, *_ in docs for b in t.encode()} | {32, 200})

    def table(lang):
        counts = {}
        for _, t, own, *_ in docs:
            if own == lang:
                raw = b"   " + t.encode()
                for i in range(3, len(raw)):
                    for k in range(4):
                        counts.setdefault(raw[i - k : i], Counter())[raw[i]] += 1
        return counts

    def chance(counts, context, byte):
        below = {b: 1 / 256 for b in range(256)}
        for k in range(4):
            seen = counts.get(context[3 - k :])
            if seen:
                total, kinds = sum(seen.values()), len(seen)
                free = 1 - sum(below[b] for b in seen)
                below = {b: seen[b] / (total + kinds) if b in seen else kinds / (total + kinds) * below[b] / free for b in below}
        return below[byte]

    for j, lang in enumerate(model.langs):
        counts = table(lang)
        for context in (b"abc", b"  a", b"zab", b"!!!", b"bca"):
            for byte in (*symbols, 7):
                got = language_id.costs(model, np.array([int.from_bytes(bytes([*context, byte]), "big")], np.uint32))[0, j]
                assert abs(got + np.log2(chance(counts, context, byte))) < 1e-3
    texts = pa.array(["abc", "abc", "x" * 3_000_000])
    bits = language_id.code_lengths(model, *W.flat(texts))
    assert (bits[0] == bits[1]).all() and (bits[2] > 1e6).all()


def test_many_languages():
    """Fifty languages of 60 000 contexts each stay under a gigabyte; cached and searched costs agree with plain escapes."""
    r, runs = np.random.default_rng(3), []
    for k in range(50):
        raw = r.integers(0, 1 << 32, 60_000, np.int64) & 0x3F3F3F3F | (k % 7) << 22
        runs.append(pd.DataFrame({"lang": f"l{k:02}", "run": np.unique(raw), "n": r.integers(1, 5, len(np.unique(raw)))}))
    model = language_id.build(pd.concat(runs))
    arrays = [a for part in model.parts for own in (part.runs, part.bits, part.contexts, part.escape) for a in own]
    assert sum(a.nbytes for a in (*arrays, model.cached, model.row, model.cost)) < 200 << 20
    asked = np.concatenate([runs[0]["run"].to_numpy()[:50], runs[9]["run"].to_numpy()[:20] ^ 3, r.integers(0, 1 << 32, 50, np.int64)]).astype(np.uint32)
    got = language_id.costs(model, asked)
    assert np.array_equal(got, language_id.resolve(model.parts, asked))
    for k in (0, 9, 31):
        counts = {}
        for run, n in zip(runs[k]["run"], runs[k]["n"], strict=True):
            raw = int(run).to_bytes(4, "big")
            for order in range(4):
                own = counts.setdefault(raw[3 - order : 3], Counter())
                own[raw[3]] += int(n)
        for run, bits in zip(asked.tolist(), got[:, k].tolist(), strict=True):
            raw, below = run.to_bytes(4, "big"), dict.fromkeys(range(256), 1 / 256)
            for order in range(4):
                if seen := counts.get(raw[3 - order : 3]):
                    total, kinds, free = sum(seen.values()), len(seen), 1 - sum(below[b] for b in seen)
                    below = {b: seen[b] / (total + kinds) if b in seen else kinds / (total + kinds) * below[b] / max(free, 1e-9) for b in below}
            assert abs(bits + np.log2(max(below[raw[3]], 1e-30))) < 1e-3


def test_final_punctuation_of_any_script(spark):
    prose = "This is a plain sentence with some words in it and it goes on for a while here. " * 2
    texts = [prose + "\n短い文。\n次の文。\nUne phrase…\nEt »", prose + "\nHome page\nAbout us\nNews", prose + "\nTOUS droits réservés"]
    got = {x.doc_id: x.n_failed_lines for x in line_quality.line_quality(spark.createDataFrame(rows(texts), DOCS)).collect()}
    assert got == {0: 0, 1: 3, 2: 1}


@pytest.mark.parametrize("f", [line_quality.line_quality, lambda d: secret_links.secrets(secret_links.numbered(d)), language_id.identify])
def test_empty_tables(spark, f):
    assert f(spark.createDataFrame([], DOCS)).count() == 0


def test_repeated_rows_and_extra_columns(spark):
    docs = spark.createDataFrame([(1, "token=abcdefgh1", 7), (1, "token=abcdefgh1", 7), (None, "x", None)], "doc_id long, text string, kind int").withColumn("start", F.lit(1))
    assert len(secret_links.secrets(secret_links.numbered(docs)).collect()) == 3
    assert sorted(r.text for r in secret_links.redact(docs).collect()) == ["[REDACTED]", "[REDACTED]", "x"]
    assert line_quality.line_quality(docs).count() == 3
    clash = docs.withColumns({c: F.lit("en") for c in ("lang", "held_out", "score", "lang_pred", "run", "n")})
    assert language_id.identify(clash).count() == 3
    labels = spark.createDataFrame([(1, 1, 0)], "doc_id long, quality int, toxic int")
    assert quality_classifier.classify(clash, labels, ["doc_id"]).count() == 3 and quality_classifier.keep_good(clash, labels).columns == clash.columns


def test_sha_of_no_spans():
    assert hashlib.sha256(b"").hexdigest() == "e3b0c44298fc1c149afbf4c8996fb92427ae41e4649b934ca495991b7852b855"

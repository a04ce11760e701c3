"""Each numbered operator against a brute-force version, on a given table and on a table of awkward rows."""

import hashlib
import re
import zlib
from collections import Counter, defaultdict
from itertools import combinations

import numpy as np
import pytest
from pyspark.sql import functions as F

from storepulse.llm import embedding_dedup, lm_scoring, mixing, packing, quality, simhash, token_counts, toxicity, url_filters, warc
from storepulse.llm.queries import URL_RULES, tokenizer_path

DOCS = "doc_id long, text string, lang string, source string, n_chars long, sequence_id long, fp string, kept string, rep string"
WORD = re.compile(r"[^\x20\x09-\x0D]+")


def awkward():
    long_text = " ".join(f"word{i % 977} Ünï{i % 31}" for i in range(6000))
    texts = [
        None, "", " \t\n", "one", "two words", "a  b   c\td\n\ne ", "Same text here, twice or more.", "Same text here, twice or more.", long_text, long_text + " end",
        "</s> <s> <|endoftext|> <unk>", "x<|ENDOFTEXT|>y <|StartOfText|> <|endoftext|>. İ. İX! ΑΣ, e\u0301. \u0301a don'T IT'S.", "naïve ﬁ ΑΣ Σ 　x\u00a0y\x1cz 日本語のテキスト 🙂", "x" * 5000, "tab\there " * 9, "| a | b | c | d\nPlain line of words.", "\x00 nul \x00", "▁ mark ▁▁ x", "loser " * 30,
    ]
    rows = [(i, t, "en", None if i % 4 == 0 else f"s{i % 3}", len(t or ""), 1, "f", "k", "r") for i, t in enumerate(texts)]
    return [*rows, rows[6], (None, "no id", None, None, None, None, None, None, None), (-5, "Same text here, twice or more.", "en", "s9", 1, 1, "f", "k", "r")]


@pytest.fixture(scope="module", params=["given", "awkward", "empty"])
def docs(request, spark, sf_dir):
    if request.param == "given":
        return spark.read.parquet(f"{sf_dir}/documents.parquet")
    return spark.createDataFrame(awkward() if request.param == "awkward" else [], DOCS)


def rows_of(docs):
    return [(r.doc_id, r.text or "") for r in docs.collect()]


def test_packing(spark, docs):
    from tokenizers import Tokenizer

    path = tokenizer_path("word_bpe_49k.json")
    tokenizer = Tokenizer.from_file(path)
    out = packing.pack_documents(docs, path, group_tokens=20_000, group_bytes=50_000).collect()
    want = Counter()
    for key, text in rows_of(docs):
        want[key, tuple(tokenizer.encode(text, add_special_tokens=False).ids) + (2,)] += 1
    by_doc, by_sequence = defaultdict(list), defaultdict(list)
    for p in out:
        by_doc[p.doc_id].append(p)
        by_sequence[p.sequence_id].append(p)
    for key in {k for k, _ in want}:
        pieces = sorted(by_doc[key], key=lambda p: p.start)
        same = [ids for (k, ids), n in want.items() if k == key for _ in range(n)]
        assert sum(p.length for p in pieces) == sum(map(len, same))
        for ids in same:
            at = 0
            while at < len(ids):
                p = next(p for p in pieces if p.start == at and p.doc_tokens == len(ids))
                assert p.ids_crc32 == zlib.crc32(np.array(ids[at : at + p.length], dtype="<u4").tobytes())
                pieces.remove(p)
                at += p.length
        assert not pieces
    assert {k for k, _ in want} == set(by_doc)
    padding = total = 0
    for pieces in by_sequence.values():
        at = 0
        for p in sorted(pieces, key=lambda p: p.offset):
            assert p.offset == at
            at += p.length
        assert at <= 4096
        total += at
        padding += 0 if at & (at - 1) == 0 else 4096 - at
    assert padding <= 0.01 * total


def test_word_ids_are_the_tokenizers():
    import random

    from tokenizers import Tokenizer

    path = tokenizer_path("word_bpe_49k.json")
    tokenizer, words, draw = Tokenizer.from_file(path), packing.WordIds(path, most=5000), random.Random(1)
    bits = [
        "<|endoftext|>", "<|ENDOFTEXT|>", "<|startoftext|>", "<|StartOfText|>", "</w>", "İ", "ß", "ẞ", "Σ", "é", "é", "\u0301", "'s", "'LL", "'t", ".", ",", "!", "?;", "ab", "Cd", "Xy", "12", "3", "日本", "ﬁ", "\u3000", "\x1c", "\x85", "\u200d",
        "🙂", "नमस्ते।", "؟", "ŉ", "ſ", "Ǆ", "Ⅷ", "ª", "º", "µ", "Ω", "Å", "K", "한", "\u1112\u1161", "#", "_", "Ġ", "\x00", "ǰ", "\ufeff",
    ]
    texts = ["".join(draw.choice(bits) + draw.choice([" ", "  ", "\n", "\t", ""]) for _ in range(draw.randint(1, 9))) for _ in range(100_000)]
    assert words.parted
    want = [e.ids for e in tokenizer.encode_batch(texts, add_special_tokens=False)]
    assert [np.frombuffer(x, dtype=words.kind).tolist() for x in words.of([t.encode() for t in texts])] == want
    whole = packing.WordIds(tokenizer_path("byte_bpe_50k.json"))
    assert not whole.parted
    want = [e.ids for e in whole.tokenizer.encode_batch(texts[:100], add_special_tokens=False)]
    assert [np.frombuffer(x, dtype=whole.kind).tolist() for x in whole.of([t.encode() for t in texts[:100]])] == want


def test_first_fit_decreasing_is_first_fit():
    random = np.random.default_rng(0)
    for n in (0, 1, 2, 37, 200):
        lengths = random.integers(1, 100, n).tolist()
        room, plain = [], []
        for i in sorted(range(n), key=lambda i: -lengths[i]):
            at = next((b for b, r in enumerate(room) if r >= lengths[i]), len(room))
            if at == len(room):
                room.append(100), plain.append([])
            room[at] -= lengths[i]
            plain[at].append(i)
        assert packing.first_fit_decreasing(lengths, 100) == plain


@pytest.mark.parametrize("head", [1 << 19, 50])
def test_token_counts(docs, head):
    import sentencepiece

    path = tokenizer_path("piece_bpe_32k.model")
    model = sentencepiece.SentencePieceProcessor(model_file=path)
    out = token_counts.count_tokens(docs, path, head=head, limit=100).collect()
    want = Counter((k, len(t.encode()), n := len(model.encode(t)), n > 100) for k, t in rows_of(docs))
    assert Counter(tuple(r) for r in out) == want


def fingerprint_of(text, k):
    import xxhash

    words = WORD.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in text))
    shingles = [" ".join(words[i : i + k]) for i in range(len(words) - k + 1)] or ([" ".join(words)] if words else [])
    ones = [0] * 64
    for s in shingles:
        h = xxhash.xxh64_intdigest(s.encode(), seed=42)
        for b in range(64):
            ones[b] += h >> b & 1
    return sum(1 << b for b in range(64) if 2 * ones[b] > len(shingles))


def least_reachable(keys, linked):
    least = {k: k for k in keys}
    changed = True
    while changed:
        changed = False
        for a, b in linked:
            m = min(least[a], least[b])
            if least[a] != m or least[b] != m:
                least[a] = least[b] = m
                changed = True
    return least


def test_simhash(docs):
    docs = docs.filter("doc_id is not null")
    fps = [(k, fingerprint_of(t, 3)) for k, t in rows_of(docs)]
    linked = [(a, b) for (a, x), (b, y) in combinations(fps, 2) if (x ^ y).bit_count() <= 3]
    least = least_reachable({k for k, _ in fps}, linked)
    want = Counter((k, f"{x:016x}", least[k]) for k, x in fps)
    assert Counter(tuple(r) for r in simhash.near_duplicates(docs).collect()) == want


def test_simhash_long_runs_are_dealt(spark):
    random = np.random.default_rng(1)
    base = int(random.integers(0, 1 << 62))
    fps = {base ^ (1 << int(a)) ^ (1 << int(b)) for a, b in random.integers(0, 63, (60, 2))} | {int(x) for x in random.integers(0, 1 << 62, 40)}
    df = spark.createDataFrame([(f,) for f in fps], "fp long")
    found = {(min(r.a, r.b), max(r.a, r.b)) for r in simhash.near_links(df, block_rows=5).collect()}
    every = [(a, b) for a, b in combinations(sorted(fps), 2) if (a ^ b).bit_count() <= 3]
    assert found <= set(every)
    assert least_reachable(fps, found) == least_reachable(fps, every)


def test_similar_groups(spark):
    random = np.random.default_rng(2)
    words = [f"w{i}" for i in range(5000)]
    texts, want = [], {}
    for g in range(30):
        base = random.choice(words, 300).tolist()
        for copy in range(4):
            own = list(base)
            for at in random.integers(0, 300, copy):  # three edits change 15 of 296 shingles at most
                own[at] = "edited"
            want[len(texts)] = 4 * g
            texts.append(" ".join(own))
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string")
    assert {r.doc_id: r.component_id for r in simhash.similar_groups(docs).collect()} == want


def test_similar_groups_within_a_template(spark):
    random = np.random.default_rng(5)
    texts = []
    for pair in range(150):  # pairs of 0.84 and more in a population of 0.77
        shared = random.choice(600, 16, replace=False)
        for side in range(2):
            own = [f"t{i}" for i in range(3000)]
            for at in shared:
                own[5 * at] = f"p{pair}"
            for at in random.choice(600, 24, replace=False):
                own[5 * at] = f"d{pair}x{side}"
            texts.append(" ".join(own))
    order = random.permutation(len(texts))
    texts = [texts[i] for i in order]
    sets = []
    for t in texts:
        w = t.split()
        sets.append({" ".join(w[i : i + 5]) for i in range(len(w) - 4)})
    similarity = {(a, b): len(sets[a] & sets[b]) / len(sets[a] | sets[b]) for a, b in combinations(range(len(texts)), 2)}
    near = [ab for ab, x in similarity.items() if x >= 0.8]
    assert len(near) >= 150 and all(similarity[ab] <= 0.88 for ab in near)
    want = least_reachable(range(len(texts)), near)
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    assert {r.doc_id: r.component_id for r in simhash.similar_groups(docs).collect()} == want
    dealt = simhash.similar_groups(docs, block_rows=5, part_bytes=1_000_000)
    assert {r.doc_id: r.component_id for r in dealt.collect()} == want


def test_one_of_each_keeps_columns(docs):
    out = simhash.one_of_each(docs)
    assert out.columns == docs.columns
    ids = [r.doc_id for r in out.collect() if r.doc_id is not None]
    assert len(ids) == len(set(ids))


SENTENCE_ENDS = {".", "!", "?", ":", ";", "…", '"', "'", "”", "’", "»", ")", "]", "。", "！", "？", "।", "؟", "۔"}


def plain_verdict(text, common):
    """(words lost to the rules of a line, words lost to boilerplate, verdict without the base rule)"""
    lost = boilerplate = total = 0
    for line in text.split("\n"):
        counted = len(WORD.findall(line))
        total += counted
        line = line.strip(" \t\r\x0b\x0c")
        words = line.split()
        if not counted or not words:
            continue
        cased = [w for w in words if w[0].isalpha()]
        menu = sum(not re.search(r"\w", w) for w in words)
        bad = (
            menu >= 3 and menu >= 0.15 * len(words)
            or sum(c in "#*$%&|<>" for c in line) > 0.1 * len(line)
            or line.isupper() and len(words) >= 4
            or line.count("!!") >= 4
            or len(cased) >= 5 and all(w[0].isupper() for w in cased) and len(words) >= 5
            or len(words) >= 10 and len(set(words)) < 0.3 * min(len(words), 200)
            or not (line[-1] in SENTENCE_ENDS or len(words) >= 5 and any(w[-1] in SENTENCE_ENDS for w in words))
        )
        if bad:
            lost += counted
        elif counted <= 30 and plain_key(line) in common:
            boilerplate += counted
    return lost, boilerplate, lost <= 0.2 * total and lost + boilerplate <= 0.5 * total


def plain_key(line):
    return re.sub("[0-9]+", "0", "".join(c.lower() if c.isascii() else c for c in " ".join(WORD.findall(line))))


def plain_boilerplate(texts):
    """Short lines of 10 documents or more, half of them or more differing in the least hash of their other lines' sentences."""
    import xxhash

    rests, counts = defaultdict(set), Counter()
    for text in texts:
        lines = {}
        for line in text.split("\n"):
            if WORD.search(line):
                lines.setdefault(plain_key(line), line)
        for key, line in lines.items():
            others = [xxhash.xxh64_intdigest(s.encode()) for k, x in lines.items() if k != key for s in x.split(".")]
            if others and len(WORD.findall(line)) <= 30:
                rests[key].add(min(others))
                counts[key] += 1
    return {k for k in rests if len(rests[k]) >= max(10, 1e-4 * len(texts)) and len(rests[k]) >= 0.5 * counts[k]}


def test_quality(docs):
    def brute(text):
        words = WORD.findall(text)
        windows = Counter(tuple(words[i : i + 8]) for i in range(len(words) - 7))
        repeated = {i + j for i in range(len(words) - 7) if windows[tuple(words[i : i + 8])] > 1 for j in range(8)}
        lines, seen, dup = text.split("\n"), set(), 0
        for line in lines:
            if WORD.search(line):
                dup += line in seen
                seen.add(line)
        base = len(words) < 20 or 100 * len(repeated) > 30 * len(words)
        return len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text), dup, len(repeated), base, not base and plain_verdict(text, common)[2]

    common = plain_boilerplate([t for _, t in rows_of(docs)])
    out = quality.quality_report(docs).collect()
    assert Counter((r.doc_id, r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed, r.kept) for r in out) == Counter((k, *brute(t)) for k, t in rows_of(docs))
    cleaned = quality.clean_documents(docs)
    assert cleaned.schema == docs.schema
    assert Counter(r.doc_id for r in cleaned.collect()) == Counter(r.doc_id for r in out if r.kept)


def test_quality_line_rules():
    rules = quality.LineRules()
    assert quality.failed_rule("Home | News | Sport | More | About", rules) == "navigation"
    assert quality.failed_rule("Home News Sport More About Contact Login.", rules) == "navigation"
    assert quality.failed_rule("Inicio • Noticias • Deportes • Contacto", rules) == "navigation"
    assert quality.failed_rule("Word*** other### thing$$$ more%%%.", rules) == "symbols"
    assert quality.failed_rule("THIS IS ALL SHOUTED.", rules) == "shouting"
    assert quality.failed_rule("go " * 30 + ".", rules) == "repetition"
    assert quality.failed_rule("a line without its end", rules) == "punctuation"
    for line in ("A plain line.", " ", "Our privacy policy debate in parliament lasted nine hours.", "Die Deutsche Bahn fährt nach Berlin.", "यह एक वाक्य है।", "ما هذا؟", "これは文です。"):
        assert quality.failed_rule(line, rules) is None
    assert set(quality.sentence_ends()) >= SENTENCE_ENDS and not any(c.isalnum() or c in ",-|#" for c in quality.sentence_ends())


def test_quality_learns_boilerplate_from_the_corpus(spark):
    random = np.random.default_rng(4)
    prose = lambda n: " ".join("".join(chr(97 + int(i) // p % 26) for p in (1, 26, 676)) for i in random.integers(0, 5000, n)) + "."
    menus = ["Cookies akzeptieren und Datenschutzerklärung lesen, danke.", "Accepter les cookies et continuer sans compte.", "Page 3 of 17."]
    texts = ["\n".join([menus[i % 3].replace("3", str(1 + i)), prose(30), prose(30)]) for i in range(90)]
    copied = [prose(25), prose(25), prose(25)]
    texts += ["\n".join(copied)] * 40  # copies of one document are no boilerplate
    for _ in range(60):  # nor are near copies of it
        own = " ".join(copied).split()
        own[25 * int(random.integers(0, 3)) + int(random.integers(0, 24))] = "edited"
        texts.append("\n".join(" ".join(own[i : i + 25]) for i in (0, 25, 50)))
    shared = prose(60)
    texts += ["\n".join([prose(40), shared, prose(40)]) for _ in range(50)]  # a long passage is no boilerplate either
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    known = quality.boilerplate_lines(docs)
    assert known == {quality.line_key(m.encode().split()) for m in menus}
    out = quality.clean_documents(docs, known=known).collect()
    assert len(out) == len(texts) and all(m not in r.text for r in out for m in menus)
    assert {plain_key(m) for m in menus} == plain_boilerplate(texts)


def test_quality_labels(spark, sf_dir):
    big = sf_dir.replace("sf0.001", "sf0.01")
    labels = spark.read.parquet(f"{big}/labels.parquet")
    out = quality.quality_report(spark.read.parquet(f"{big}/documents.parquet")).join(labels, "doc_id").collect()
    good = [r.kept for r in out if r.quality == 1 and not r.base_failed]
    assert sum(good) >= 0.98 * len(good)
    bad = [r.kept for r in out if r.quality == 0]
    assert sum(bad) <= 0.1 * len(bad)


def test_mixing(docs):
    out = mixing.mix_sources(docs).collect()
    sized = [(r.doc_id, r.source, len(WORD.findall(r.text or ""))) for r in docs.collect()]
    sizes = defaultdict(int)
    for _, s, n in sized:
        sizes[s] += n
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: (5, 2, 1)[i % 3] for i, s in enumerate(order)}
    target, left, free = {}, 1.5 * sum(sizes.values()), set(order)
    while free:
        level = left / sum(weight[s] for s in free)
        over = {s for s in free if level * weight[s] > 2 * sizes[s]}
        if not over:
            target.update({s: level * weight[s] for s in free})
            break
        target.update({s: 2.0 * sizes[s] for s in over})
        left -= sum(2.0 * sizes[s] for s in over)
        free -= over
    assert len(out) == len(sized)
    want = Counter((k, n, sizes[s], round(target[s], 6)) for k, s, n in sized)
    assert Counter((r.doc_id, r.size, r.source_size, round(r.target, 6)) for r in out) == want
    assert all(r.taken <= 2 * r.size for r in out)
    assert sorted(map(str, out)) == sorted(map(str, mixing.mix_sources(docs).collect()))
    assert mixing.mixed_documents(docs).columns == docs.columns
    assert mixing.mixed_documents(docs).count() == sum(r.copies for r in out)


def test_url_filters(spark, sf_dir):
    urls = [
        None, "", "no scheme", "http://", "http://com", "http://com/", "http://COM/x", "https://a.net/es/1?x", "https://a.net/fr/", "https://net/es/", "http://example.com/en/1", "http://x.www.example.com/en/a#b", "http://www.example.com/de/",
        "http://.com/", "http://example.com./en/", "http://notexample.com/en/", "http://example.com:80/en/", "http://u@example.com/en/", "a://b://c.com/en/", "http://a-b.com/?q", "http://ex,ample.com/en/", "http://example.com?x/en/", "http://ÉXAMPLE.com/É/",
    ]
    given = [r.url for r in spark.read.parquet(f"{sf_dir}/pages.parquet").collect()]
    pages = [(i, u, "clash", "clash") for i, u in enumerate([*urls, *given, *given[:3] * 20])]

    def brute(url):
        host = path = ""
        if url and "://" in url:
            rest = url.split("://", 1)[1]
            host = re.match(r"[^/?#]*", rest)[0]
            path = re.match(r"[^?#]*", rest[len(host) :])[0]
        host = "".join(c.lower() if "A" <= c <= "Z" else c for c in host)
        fit = [(len(h + p), h + p, v) for v, h, p in URL_RULES if (host == h or host.endswith("." + h)) and path.startswith(p)]
        best = max(fit, default=(0, None, "allow"))
        return host, path, best[1], best[2]

    df = spark.createDataFrame(pages, "page_id long, url string, host string, key string")
    out = url_filters.judge_urls(df, url_filters.rule_table(spark, URL_RULES)).collect()
    assert {tuple(r) for r in out} == {(i, *brute(u)) for i, u, *_ in pages} and len(out) == len(pages)
    assert url_filters.judge_urls(df.limit(0), url_filters.rule_table(spark, URL_RULES)).collect() == []


def test_url_filters_with_many_rules(spark):
    random = np.random.default_rng(8)
    hosts = [f"h{i}.d{i % 500}.com" for i in range(99_000)] + [f"d{i}.com" for i in range(500)] + ["com", "ex.com", "a.b.c.com"]
    rules = [(("allow", "block")[i % 2], h, ("/", "/a/", "")[i % 3]) for i, h in enumerate(hosts)] + [("block", "d1.com", f"/p{i}/") for i in range(1000)]
    known = defaultdict(list)
    for v, h, p in rules:
        known[h].append((len(h + p), len(h), h + p, p, v))
    urls = [f"http://{h}{p}" for h in random.choice(hosts, 2000) for p in ("/", "/a/b")] + ["http://x.h7.d7.com/a/", "http://d1.com/p77/x", "http://ex,ample.com/", "http://com.ex/", "http://org/"]

    def brute(url):
        host, path = re.match(r"http://([^/]*)(.*)", url).groups()
        labels = host.split(".")
        fit = [r for i in range(len(labels)) for r in known[".".join(labels[i:])] if path.startswith(r[3])]
        return max(fit)[2] if fit else None, max(fit)[4] if fit else "allow"

    pages = spark.createDataFrame(list(enumerate(urls)), "page_id long, url string")
    table = spark.createDataFrame(rules, "verdict string, host string, path string")
    out = {r.page_id: (r.rule, r.verdict) for r in url_filters.judge_urls(pages, table).collect()}
    assert out == {i: brute(u) for i, u in enumerate(urls)}
    assert {r.verdict for r in url_filters.judge_urls(pages, table.limit(0)).collect()} == {"allow"}


def test_url_filters_nested_paths_on_one_host(spark):
    """Prefixes nested 60 deep on one host, equal rules of two verdicts, rules that fit nothing, and a hot url on most rows."""
    rules = [("block" if i % 2 else "allow", "h.com", "/" + "a" * i) for i in range(60)] + [("allow", "com", "/" + "a" * 40), ("block", "h.com", "/b/"), ("allow", "h.com", "/b/"), ("block", "h.com", "/q?x"), ("block", "h/com", ""), ("block", None, "/"), ("block", "", "/")]
    urls = ["http://h.com/" + "a" * i + tail for i in range(0, 64, 3) for tail in ("", "b", "\U0010ffff\U0010ffffx")] + ["http://x.h.com/b/c", "http://y.com/" + "a" * 50, "http://y.com/", "http://com./" + "a" * 9, "http://h.com?x", None, "//"]
    urls += ["http://h.com/aaab"] * 500

    def brute(url):
        host, path = re.match(r"[a-z]*://([^/?]*)([^?]*)", url).groups() if url and "://" in url else ("", "")
        fit = [(len(h + p), len(h), h + p, v) for v, h, p in rules if h is not None and (host == h or host.endswith("." + h)) and path.startswith(p)]
        return max(fit)[2:] if fit else (None, "allow")

    pages = spark.createDataFrame(list(enumerate(urls)), "page_id long, url string")
    table = spark.createDataFrame(rules, "verdict string, host string, path string")
    out = {r.page_id: (r.rule, r.verdict) for r in url_filters.judge_urls(pages, table).collect()}
    assert out == {i: brute(u) for i, u in enumerate(urls)}


def test_embeddings(spark, sf_dir):
    random = np.random.default_rng(3)
    base = random.standard_normal((40, 16))
    rows = []
    for g, b in enumerate(base):
        for copy in range(1 + g % 5):
            rows.append((len(rows), (b + random.standard_normal(16) * 0.03).astype(np.float32).tolist(), g % 3))
        rows.append((len(rows), rows[-1][1], g % 3))
    hub = random.standard_normal(16)
    rows += [(1000 + i, (hub + random.standard_normal(16) * 0.05).astype(np.float32).tolist(), 1) for i in range(60)]
    odd = [None, [], [0.0] * 16, [None] + [1.0] * 15, [float("nan")] + [1.0] * 15, [float("inf")] + [1.0] * 15]
    rows += [(2000 + i, v, 1) for i, v in enumerate(odd)] + [(3000, rows[0][1], None), (3001, rows[0][1], 2), (3002, [1.0, 0.0], 1), (3003, [1.0, 0.01], 1)]
    df = spark.createDataFrame([(*r, "clash", 1) for r in rows], "vec_id long, embedding array<float>, label int, rep string, code int")

    def usable(v, label):
        return label is not None and v and all(x is not None and np.isfinite(x) for x in v) and any(v)

    linked = []
    for (a, x, p), (b, y, q) in combinations(rows, 2):
        if p == q and usable(x, p) and usable(y, q) and len(x) == len(y):
            u, v = np.array(x, dtype=float), np.array(y, dtype=float)
            if u @ v / np.linalg.norm(u) / np.linalg.norm(v) >= 0.93:
                linked.append((a, b))
    least, degree = least_reachable({r[0] for r in rows}, linked), Counter(x for p in linked for x in p)
    out = embedding_dedup.near_duplicate_vectors(df).collect()
    assert {tuple(r) for r in out} == {(k, degree[k], least[k], least[k] == k) for k in least}
    assert embedding_dedup.near_duplicate_vectors(df.limit(0)).collect() == []
    given = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    assert embedding_dedup.near_duplicate_vectors(given).filter("n_links = 0 and component_id = vec_id").count() == given.count()


@pytest.mark.parametrize("options", [{}, {"tables": 1, "window": 1, "k": 2, "rounds": 1, "sample": 64}, {"tables": 1, "window": 1, "k": 2, "rounds": 1, "most_turns": 1}])
def test_embeddings_recall(spark, options):
    random = np.random.default_rng(7)
    base = random.standard_normal((3000, 64))
    base /= np.linalg.norm(base, axis=1, keepdims=True)
    off = random.standard_normal((3000, 64))
    off -= (off * base).sum(axis=1, keepdims=True) * base
    off /= np.linalg.norm(off, axis=1, keepdims=True)
    x = np.concatenate([base, 0.94 * base + np.sqrt(1 - 0.94**2) * off])  # 3000 pairs at cosine 0.94
    order = random.permutation(len(x))
    df = spark.createDataFrame([(int(i), x[i].tolist(), 0) for i in order], "vec_id long, embedding array<double>, label int")
    true = x @ x.T >= 0.93
    np.fill_diagonal(true, False)
    want = true.sum(axis=1)
    out = {r.vec_id: r.n_links for r in embedding_dedup.near_duplicate_vectors(df, **options).collect()}
    found = np.array([out[i] for i in range(len(x))])
    assert (found <= want).all() and found.sum() >= 0.95 * want.sum()


def test_audit_is_brute_force(spark):
    random = np.random.default_rng(9)
    x = np.repeat(random.standard_normal((20, 8)), 5, axis=0) + 0.15 * random.standard_normal((100, 8))
    df = spark.createDataFrame([(i, i % 2, v.tolist()) for i, v in enumerate(x)] + [(500, 0, [1.0, 2.0])], "rep long, label int, v array<double>")
    unit = x / np.linalg.norm(x, axis=1, keepdims=True)
    want = {(i, j) for i, j in np.argwhere(unit @ unit.T >= 0.93).tolist() if i != j and i % 2 == j % 2}
    truth = embedding_dedup._audit(df, 0.93, 1000, 0)
    assert {tuple(r) for r in truth.collect()} == want
    part = {r.a for r in embedding_dedup._audit(df, 0.93, 30, 0).collect()}
    assert 0 < len(part) <= 30 and part != {r.a for r in embedding_dedup._audit(df, 0.93, 30, 1).collect()}
    some = sorted({(a, b) for a, b in want if a < b})[::2]
    each = [np.mean([(min(p), max(p)) in some for p in want if p[0] == a]) for a in {a for a, _ in want}]
    edges = spark.createDataFrame(some, "a long, b long")
    assert 0 < embedding_dedup._recall(truth, edges) <= np.mean(each) + 1e-9
    whole = spark.createDataFrame([(i % 2, i, True) for i in range(100)], "component long, rep long, saturated boolean")
    assert embedding_dedup._recall(truth, edges.limit(0), whole) == 1 and embedding_dedup._recall(truth, edges.limit(0), whole.withColumn("saturated", F.lit(False))) == 0
    assert embedding_dedup._recall(truth.limit(0), edges) is None


def test_embeddings_of_a_chain_are_the_graphs_edges(spark, monkeypatch):
    """A long chain of near vectors is one component, but no class of it is compared whole; a hub with most classes in reach is, against its own component alone."""
    random = np.random.default_rng(5)
    size, n = 24, 500
    x, chain = random.standard_normal(size), []
    for _ in range(n):  # neighbours at about 20 degrees
        x = x / np.linalg.norm(x)
        chain.append(x)
        step = random.standard_normal(size)
        step -= (step @ x) * x
        x = x + 0.36 * step / np.linalg.norm(step)
    hub = random.standard_normal(size)
    hub /= np.linalg.norm(hub)
    spokes = random.standard_normal((250, size))
    spokes -= (spokes @ hub)[:, None] * hub
    spokes = hub + 0.38 * spokes / np.linalg.norm(spokes, axis=1, keepdims=True)
    x = np.concatenate([chain, [hub], spokes])
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    true = x @ x.T >= 0.93
    np.fill_diagonal(true, False)
    assert true[n].sum() == 250 and true[:n].sum(axis=1).max() < 12
    asked = []
    compared = embedding_dedup._compared
    monkeypatch.setattr(embedding_dedup, "_compared", lambda members, *a: (asked.append([r.rep for r in members.filter("saturated").collect()]), compared(members, *a))[1])
    df = spark.createDataFrame([(i, v.tolist(), 0) for i, v in enumerate(x)], "vec_id long, embedding array<double>, label int")
    out = {r.vec_id: r for r in embedding_dedup.near_duplicate_vectors(df).collect()}
    found = np.array([out[i].n_links for i in range(len(x))])
    assert (found <= true.sum(axis=1)).all() and found.sum() >= 0.97 * true.sum() and found[n] == 250
    least = least_reachable(range(len(x)), [tuple(p) for p in np.argwhere(true).tolist()])
    assert np.mean([out[i].component_id == least[i] for i in range(n, len(x))]) == 1
    assert [i for some in asked for i in some] == [n]


@pytest.mark.parametrize("share", [1, 3])
def test_components_compared_in_blocks(spark, share):
    random = np.random.default_rng(4)
    x = np.repeat(random.standard_normal((3, 8)), 10, axis=0) + 0.2 * random.standard_normal((30, 8))
    full = np.arange(30) % share == 0
    df = spark.createDataFrame([(7, i, v.tolist(), 1 + i % 3, bool(full[i])) for i, v in enumerate(x)] + [(8, 99, x[0].tolist(), 1, False)], "component long, rep long, v array<double>, weight long, saturated boolean")
    out = embedding_dedup._compared(df, 0.93, block=4).collect()
    unit = x / np.linalg.norm(x, axis=1, keepdims=True)
    linked = (unit @ unit.T >= 0.93) & ~np.eye(30, dtype=bool) & (full[:, None] | full)
    got = defaultdict(int)
    for r in out:
        if r.b is None:
            got[r.a] += r.n
    assert [got[i] for i in range(30)] == (linked @ (1 + np.arange(30) % 3)).tolist()
    every = [tuple(p) for p in np.argwhere(linked).tolist()]
    assert least_reachable(range(30), [(r.a, r.b) for r in out if r.b is not None]) == least_reachable(range(30), every)


def test_lm_scores(spark, docs):
    net = lm_scoring.train(docs, rounds=2)
    out = lm_scoring.score_documents(docs, net).collect()
    assert Counter((r.doc_id, r.n_words) for r in out) == Counter((k, len(WORD.findall(t))) for k, t in rows_of(docs))
    assert all(np.isfinite(r.log_likelihood) and r.log_likelihood <= 0 and (r.per_word is None) == (r.n_words == 0) for r in out)
    assert len(net.words) <= np.ceil(np.sqrt(sum(r.n_words for r in out)))
    again = lm_scoring.score_documents(docs, lm_scoring.train(docs, rounds=2)).collect()
    assert sorted(map(str, out)) == sorted(map(str, again))
    if len(out) < 100:
        want = Counter((k, round(plain_likelihood(net, t), 2)) for k, t in rows_of(docs))
        got = Counter((r.doc_id, round(r.log_likelihood, 2)) for r in out)
        assert all(min(abs(v - w) for j, w in want if j == k) < 0.02 + 1e-5 * abs(v) for k, v in got)


def plain_likelihood(net, text):
    """The definition, word by word: P(class) P(word in class), and for words outside the vocabulary the bytes before the last, from the end."""
    words = text.encode().lower().split()
    total, n = 0.0, net.side**2
    logs, backoff = (dict(zip(a.tolist(), b.tolist(), strict=True)) for a, b in ((net.spelling.codes, net.spelling.logs), (net.spelling.pairs, net.spelling.backoff)))
    place = {w: i for i, w in enumerate(net.words)}
    classes, members = net.outer_class.astype(float), net.outer_word.astype(float)
    ids = [place.get(w, len(place) + w[-1]) for w in words]
    softmax = lambda z: np.exp(z - z.max()) / np.exp(z - z.max()).sum()
    for i, (word, own) in enumerate(zip(words, ids, strict=True)):
        h = np.zeros(net.inner.shape[1])
        for j, d in enumerate(d for d in range(-net.reach, net.reach + 1) if d):
            if 0 <= i + d < len(ids):
                h += net.inner[ids[i + d]].astype(float) * net.places[j]
        h = np.append(np.tanh(h), 1)
        c = own // net.side
        total += np.log(softmax(classes @ h)[c]) + np.log(softmax(members[c * net.side : (c + 1) * net.side] @ h)[own % net.side])
        if own >= len(net.words):
            one, two = word[-1], lm_scoring.GAP
            for byte in [*word[-2::-1], lm_scoring.GAP]:
                pair = two << 8 | one
                total += logs.get(pair << 8 | byte, backoff.get(pair, net.spelling.floor))
                one, two = byte, one
    assert n == len(net.outer_word)
    return total


def test_lm_spelling_counts_every_word(spark):
    rows = spark.createDataFrame([(b"ab", 3), (b"cab", 2), (b"b", 1)], "word binary, n long")
    spelling = lm_scoring.spelling_of(rows)
    gap = lm_scoring.GAP
    seen = {(97, 98, gap): 5, (gap, 97, 98): 3, (99, 97, 98): 2, (gap, 99, 97): 2, (gap, 98, gap): 1}
    assert spelling.codes.tolist() == sorted((z << 8 | y) << 8 | x for x, y, z in seen)
    totals = Counter()
    for (_, y, z), n in seen.items():
        totals[y, z] += n
    want = {(z << 8 | y) << 8 | x: np.log((n + 8 / 256) / (totals[y, z] + 8)) for (x, y, z), n in seen.items()}
    assert np.allclose(spelling.logs, [want[c] for c in spelling.codes.tolist()])
    # over all bytes before "b" at a word's end the probabilities sum to one
    every = [spelling.codes.tolist().index(c) if (c := (gap << 8 | 98) << 8 | x) in want else None for x in range(256)]
    assert np.isclose(sum(np.exp(spelling.logs[i]) if i is not None else np.exp(spelling.backoff[spelling.pairs.tolist().index(gap << 8 | 98)]) for i in every), 1)


def small_network(size=8, reach=2):
    words = [f"w{i}".encode() for i in range(28)]
    return lm_scoring.WindowNetwork.fresh(words, [1] * 28, 28, size, reach, 0)


def test_groups_of_a_small_table_take_no_star_round(spark, monkeypatch):
    from storepulse.operators import components

    monkeypatch.setattr(components, "_large_star", lambda *_: pytest.fail("a round of star steps for a few edges"))
    words = [f"w{i}" for i in range(400)]
    texts = [" ".join(words[:200] + words[200 + k : 210 + k]) for k in range(4)] + [" ".join(words[220:])]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    assert {r.doc_id: r.component_id for r in simhash.similar_groups(docs).collect()} == {0: 0, 1: 0, 2: 0, 3: 0, 4: 4}


def test_lm_words_outside_the_vocabulary_are_looked_up_without_keeping_them():
    codes, owner = lm_scoring.spelling_codes([b"abba", b"abc"])
    names, n = np.unique(codes, return_counts=True)
    net = lm_scoring.WindowNetwork.fresh([b"the", b"a"], [5, 3], 2, 4, 2, 1, lm_scoring.Spelling.of(names, n))
    index = net.index()
    texts, outside, owner = net.ids([b"The abba a", b"", b"zebra\tthe \xff"], index)
    assert [t.tolist() for t in texts] == [[0, 2 + ord("a"), 1], [], [2 + ord("a"), 0, 2 + 255]]
    assert (outside, owner.tolist(), len(index)) == ([b"abba", b"zebra", b"\xff"], [0, 2, 2], 2)
    spelling = net.spelling
    logs, backoff = dict(zip(spelling.codes.tolist(), spelling.logs, strict=True)), dict(zip(spelling.pairs.tolist(), spelling.backoff, strict=True))
    for word in [b"abba", b"zebra", b"\xff", b"bba", b"xbb"]:
        padded = b" " + word + b"  "
        want = sum(logs.get((z << 8 | y) << 8 | x, backoff.get(z << 8 | y, spelling.floor)) for x, y, z in zip(padded, padded[1:], padded[2:-1], strict=False))
        assert np.isclose(spelling.log_likelihoods([word])[0], want)


def test_lm_gradients_are_the_slopes():
    random = np.random.default_rng(3)
    net = small_network()
    net = lm_scoring.WindowNetwork(net.words, net.side, net.reach, net.spelling, *(a.astype(np.float64) for a in net.arrays()))
    texts = [random.integers(0, 40, n).astype(np.int32) for n in (7, 1, 12)]
    row, places, _ = net.padded(texts)
    (ids, d_inner), *whole = net.gradients(row, places)
    sparse = np.zeros_like(net.inner)
    sparse[ids] = d_inner
    value = lambda: net.log_likelihoods(texts).sum()
    for array, slope in zip(net.arrays(), [sparse, *whole], strict=True):
        flat, want = array.reshape(-1), slope.reshape(-1)
        for i in [*np.argsort(-np.abs(want))[:12], *random.integers(0, len(flat), 12)]:
            if array is net.inner and i >= (len(net.inner) - 1) * net.inner.shape[1]:
                continue
            kept, step = flat[i], 1e-3
            flat[i] = kept + step
            high = value()
            flat[i] = kept - step
            low = value()
            flat[i] = kept
            assert abs((high - low) / (2 * step) - want[i]) < 1e-2 * max(1, abs(want[i]))


def test_lm_distribution_sums_to_one_and_learns():
    random = np.random.default_rng(5)
    net = small_network()
    texts = [np.array([(s + i) % 28 for i in range(40)], dtype=np.int32) for s in random.integers(0, 28, 20)]
    row, places, _ = net.padded(texts)
    h, _ = net.hidden(row)
    h = h[:50]
    whole = sum(np.exp(net.log_probabilities(h, np.full(50, t))) for t in range(net.side**2))
    assert np.allclose(whole, 1, atol=1e-4)
    before = net.log_likelihoods(texts).sum()
    squares = [np.ones_like(a) for a in net.arrays()]
    for _ in range(60):
        net.step(row, places, 0.1, squares)
    assert net.log_likelihoods(texts).sum() > before + 0.5 * len(places)
    assert np.allclose(net.log_likelihoods(texts, batch=7), net.log_likelihoods(texts), rtol=1e-4)


def test_lm_tells_the_corpus_from_noise(spark, sf_dir):
    big = sf_dir.replace("sf0.001", "sf0.01")
    docs = spark.read.parquet(f"{big}/documents.parquet").filter("lang = 'en'")
    net = lm_scoring.train(docs)
    shuffled = docs.withColumn("text", F.array_join(F.transform(F.split("text", " "), lambda w: F.reverse(w)), " "))
    mean = lambda d: lm_scoring.score_documents(d, net).agg(F.sum("log_likelihood") / F.sum("n_words")).first()[0]
    assert mean(docs) > mean(shuffled) + 1


def test_maximal_segments():
    def brute(scores):
        """Ruzzo-Tompa by definition: the best segment, then the same left and right of it."""
        if not scores or max(scores) <= 0:
            return []
        sums = np.r_[0, np.cumsum(scores)]
        best = max(((sums[b] - sums[a], -(b - a), -a, a, b) for a in range(len(scores)) for b in range(a + 1, len(scores) + 1)))
        a, b = best[3], best[4]
        left, right = brute(scores[:a]), brute(scores[b:])
        return [*left, (a, b - 1, round(best[0], 6)), *((x + b, y + b, s) for x, y, s in right)]

    random = np.random.default_rng(6)
    for _ in range(200):
        scores = np.where(random.random(12) < 0.4, random.integers(1, 9, 12) + random.random(12), -1.5).tolist()
        found = toxicity.maximal_segments([(i, s) for i, s in enumerate(scores) if s > 0], -1.5)
        assert [(a, b, round(s, 6)) for a, b, s in found] == brute(scores)


def test_maximal_segments_in_linear_time():
    import time

    random = np.random.default_rng(7)
    places = np.cumsum(random.integers(1, 20, 64_000)).tolist()
    began = time.perf_counter()
    toxicity.maximal_segments(list(zip(places, (2 * random.random(64_000)).tolist(), strict=True)), -0.3)
    assert time.perf_counter() - began < 1


def test_toxicity_scores_every_saying_of_a_word():
    model = toxicity.ToxicityModel(odds={"vile": 2.0, "foul": 2.0})
    passage = ["vile", "foul"] * 4
    words = [*(["vile", "foul", *["calm"] * 40] * 9), *passage, *["calm"] * 60, *passage]
    found = [(a, b, round(s, 6)) for a, b, s in model.passages(words) if b - a > 1]
    start = 9 * 42
    assert found == [(start, start + 7, 16.0), (start + 68, start + 75, 16.0)]
    assert len(model.passages(words)) == 11


def test_toxicity_held_out(spark, sf_dir):
    big = sf_dir.replace("sf0.001", "sf0.01")
    documents, labels = spark.read.parquet(f"{big}/documents.parquet"), spark.read.parquet(f"{big}/labels.parquet")
    model = toxicity.train(documents, labels)
    out = toxicity.score_documents(documents, model).join(labels, "doc_id").filter(F.crc32(F.col("doc_id").cast("string")) % 5 == 0).collect()
    right = sum(r.predicted == r.toxic for r in out)
    assert right >= 0.9 * len(out)
    assert all(0 <= r.score <= 1 and (r.predicted == 1) == (r.score >= 0.5) for r in out)


def test_toxicity_scores_by_brute_force(spark):
    """The model and every score from their definitions: counts, bounds, segments, extreme-value law and logistic map."""
    random = np.random.default_rng(12)
    calm, vile = [f"calm{'abcdefghij'[i % 10]}{'klmnopqrst'[i // 10]}" for i in range(100)], ["vilely", "foulest", "grimmer", "nastily"]
    texts, marks = [], []
    for i in range(120):
        words = random.choice(calm, random.integers(5, 60)).tolist()
        if i % 3 == 0:
            at = random.integers(0, len(words))
            words[at:at] = random.choice(vile, random.integers(1, 6)).tolist()
        texts.append(" ".join(words)), marks.append(int(i % 3 == 0))
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    labels = spark.createDataFrame(list(enumerate(marks)), "doc_id long, toxic int")
    out = {r.doc_id: r.score for r in toxicity.score_documents(docs, toxicity.train(docs, labels)).collect()}

    fit = [i for i in range(120) if zlib.crc32(str(i).encode()) % 5]
    forms = lambda w: {w} | {w[:k] + "*" for k in (3, 4, 5) if len(w) >= k}
    of = [Counter(f for i in fit if marks[i] == c for f in set().union(*map(forms, texts[i].split()))) for c in (0, 1)]
    good, bad = (sum(marks[i] == c for i in fit) for c in (0, 1))
    mass, odds = min(200, max(5, 0.06 * len(fit))), {}
    for f in of[0].keys() | of[1].keys():
        share = (of[0][f] + of[1][f] + 0.5) / (len(fit) + 1)
        a, rest = share * mass, (1 - share) * mass
        gap = np.log((of[1][f] + a) / (bad - of[1][f] + rest)) - np.log((of[0][f] + a) / (good - of[0][f] + rest))
        error = np.sqrt(1 / (of[1][f] + a) + 1 / (of[0][f] + a))
        if gap / error >= 2.2 and gap - 1.28 * error >= 0.5 and of[0][f] <= 0.02 * good:
            odds[f] = gap - 1.28 * error
    assert odds
    values = [[min(6.0, max((odds[f] for f in forms(w) if f in odds), default=-0.3)) for w in t.split()] for t in texts]

    def segments(x):
        if not x or max(x) <= 0:
            return []
        sums = np.r_[0, np.cumsum(x)]
        best, _, a, b = max((sums[b] - sums[a], a - b, a, b) for a in range(len(x)) for b in range(a + 1, len(x) + 1))
        return [*segments(x[:a]), best, *segments(x[b:])]

    parts = [segments(x) for x in values]
    steps = [-0.3 if v <= 0 else np.ceil(2 * v) / 2 for i in fit if not marks[i] for v in values[i]]
    mean = lambda k: np.mean(np.exp(k * np.array(steps)))
    low, high = 1e-3, 3.0
    while high - low > 1e-12:
        low, high = ((low + high) / 2, high) if mean((low + high) / 2) < 1 else (low, (low + high) / 2)
    scale = np.exp(np.clip(np.mean([low * max(parts[i], default=0) - np.log(len(values[i])) for i in fit if not marks[i]]) - np.euler_gamma, -12, 3))

    def evidence(i):
        over = [low * s - np.log(max(1, scale * len(values[i]))) for s in [*parts[i], 0]]
        total = sum(v for v in over if v > 0) or max(over)
        return np.sign(total) * np.log1p(abs(total))

    x, y = np.array([evidence(i) for i in range(120)]), np.array(marks)
    w = np.zeros(2)
    for _ in range(200_000):  # plain gradient ascent of the penalised likelihood
        pull = np.array([((y - 1 / (1 + np.exp(-x * w[0] - w[1]))) * c)[fit].sum() for c in (x, np.ones(120))]) - 1e-2 * w
        w = w + 0.005 * pull
        if np.abs(pull).max() < 1e-9:
            break
    want = 1 / (1 + np.exp(-x * w[0] - w[1]))
    assert max(abs(out[i] - want[i]) for i in range(120)) < 1e-6


def test_toxicity_awkward(spark, docs):
    labels = spark.createDataFrame([(17, 1), (6, 0), (3, 0), (None, 1), (8, None)], "doc_id long, toxic int")
    for some in (labels, labels.limit(0)):
        model = toxicity.train(docs, some)
        out = toxicity.score_documents(docs, model)
        assert out.count() == docs.count() and out.filter("score is null or not (score between 0 and 1)").count() == 0
        assert toxicity.clean_documents(docs, model).schema == docs.schema


PAGES = "page_id long, url string, html string, digest string, key string"


def test_warc(spark, sf_dir, tmp_path):
    big, small = "<p>Ünï</p>" * 300, "x" * 999
    given = [(r.page_id + 100, r.url, r.html) for r in spark.read.parquet(f"{sf_dir}/pages.parquet").collect()]
    rows = [(1, "http://a/b c", big), (2, None, big), (3, "u", big), (4, "u", small), (5, "u", small), (6, "u", None), (7, "u", ""), (None, "u", big), (3, "u", big), (8, "u", "y" * 1000), (9, "u", "y" * 1000), *given]
    df = spark.createDataFrame([(*r, "clash", "clash") for r in rows], PAGES)
    last = {}
    for k, _, h in rows:
        if k is not None and len((h or "").encode()) >= 1000:
            last[h] = max(last.get(h, k), k)
    want = Counter()
    for k, _, h in rows:
        data = (h or "").encode()
        again = k is not None and len(data) >= 1000 and k < last[h]
        want[k, len(data), hashlib.sha1(data).hexdigest(), "revisit" if again else "response", last[h] if again else None] += 1
    for archive_bytes in (1 << 24, 10_000):
        path = f"{tmp_path}/a{archive_bytes}"
        warc.write_archives(df, path, archive_bytes=archive_bytes)
        out = warc.read_archives(spark, path).collect()
        assert Counter((r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in out) == want
        assert all((r.payload is None) == (r.record_type == "revisit") for r in out)
        assert Counter(bytes(r.payload) for r in out if r.payload is not None) == Counter((h or "").encode() for (k, _, h) in rows if not (k is not None and len((h or "").encode()) >= 1000 and k < last[h]))
    warc.write_archives(df.limit(0), f"{tmp_path}/none")
    assert warc.read_archives(spark, f"{tmp_path}/none").collect() == []


@pytest.mark.parametrize("hubs", [3, 4096])
def test_revisits_of_hot_payloads(spark, hubs):
    """A third of the rows is one payload; with 3 hubs it alone is broadcast, with 4096 every group is."""
    bodies = [b"hot" if i % 3 == 0 else b"pair %d" % (i // 40) if i % 3 == 1 else b"own %d" % i for i in range(600)]
    rows = [(i if i % 50 else None, b * 5) for i, b in enumerate(bodies)] + [(7, bodies[7] * 5), (8, None)]
    df = spark.createDataFrame(rows, "page_id long, payload binary")
    last: dict = {}
    for i, b in rows:
        if i is not None and b and len(b) >= 15:
            last[b] = max(i, last.get(b, i))
    want = sorted({(i, last[b]) for i, b in rows if i is not None and b in last and i < last[b]})
    assert sorted(tuple(r) for r in warc.resolve_revisits(df, 15, hubs).collect()) == want and len(want) > 300
    assert warc.resolve_revisits(df.limit(0), 15, hubs).collect() == []


def test_warc_validation():
    import zstandard

    one = warc.record(1, "u", b"payload", hashlib.sha1(b"payload").hexdigest(), None, False)
    press = zstandard.ZstdCompressor()
    data = warc.skippable(b"") + press.compress(one) + warc.SEPARATOR.encode() + press.compress(one)
    assert list(warc.frames_of(data)) == [one, one]
    for broken in (data[:-3], data[:6], b"\x00\x01\x02\x03" + data, data + b"ab"):
        with pytest.raises(warc.BadArchive):
            list(warc.frames_of(broken))
    assert warc.parse_record(one)["payload"] == b"payload"
    for broken in (one[:-1], one.replace(b"Content-Length: 7", b"Content-Length: 8"), one.replace(b"payload\r\n\r\n", b"PAYLOAD\r\n\r\n"), one.replace(b"WARC/1.1", b"WARC/9"), one.replace(b"WARC-Date", b"WARC-Dote")):
        with pytest.raises(warc.BadArchive):
            warc.parse_record(broken)


def shingles(text, k=5):
    words = WORD.findall("".join(c.lower() if c.isascii() else c for c in text))
    return frozenset(" ".join(words[i : i + k]) for i in range(len(words) - k + 1)) or (frozenset([" ".join(words)]) if words else frozenset())


def test_short_texts_of_one_shingle_are_not_mixed_up(spark):
    texts = [f"short text number {i}" for i in range(3000)]
    out = simhash.similar_groups(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()
    assert all(r.doc_id == r.component_id for r in out) and len(out) == 3000


def test_similar_groups_recall_on_the_given_table(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir.replace('sf0.001', 'sf0.01')}/documents.parquet")
    sets = {r.doc_id: shingles(r.text or "") for r in docs.collect()}
    holders, near = defaultdict(list), set()
    for k, s in sets.items():
        for x in s:
            holders[x].append(k)
    counts = Counter(p for ids in holders.values() if len(ids) > 1 for p in combinations(sorted(ids), 2))
    for (a, b), n in counts.items():
        if n >= 0.8 * (len(sets[a]) + len(sets[b]) - n):
            near.add((a, b))
    group = {r.doc_id: r.component_id for r in simhash.similar_groups(docs).collect()}
    assert near and sum(group[a] == group[b] for a, b in near) >= 0.95 * len(near)
    least = least_reachable(sets, near)
    assert all(least[k] == least[c] for k, c in group.items())


def test_one_of_equal_ids_is_chosen_by_rule(spark):
    rows = [(1, "b text", "x"), (1, "a text", "y"), (1, "a text", "y"), (1, None, "z"), (2, "other words", None)]
    for order in (rows, rows[::-1]):
        out = simhash.one_of_each(spark.createDataFrame(order, "doc_id long, text string, row string").withColumn("tags", F.create_map(F.lit("k"), F.lit(1))))
        assert sorted((r.doc_id, r.text, r.row) for r in out.collect()) == [(1, None, "z"), (2, "other words", None)]


def plain_pipeline(rows, labels, spark):
    """What run() packs, as (doc_id, ids) per copy, stage by stage in plain Python; the toxicity model is the library's, tested on its own."""
    from tokenizers import Tokenizer

    common = plain_boilerplate([t or "" for _, t, *_ in rows])
    staying = []
    for key, text, source in rows:
        text = text or ""
        words = WORD.findall(text)
        windows = Counter(tuple(words[i : i + 8]) for i in range(len(words) - 7))
        repeated = {i + j for i in range(len(words) - 7) if windows[tuple(words[i : i + 8])] > 1 for j in range(8)}
        if len(words) >= 20 and 100 * len(repeated) <= 30 * len(words) and plain_verdict(text, common)[2]:
            lines = [x for x in text.split("\n") if not WORD.search(x) or (plain_verdict(x, set())[0] == 0 and not (len(WORD.findall(x)) <= 30 and plain_key(x) in common))]
            staying.append((key, "\n".join(lines), source))
    frame = spark.createDataFrame(staying, "doc_id long, text string, source string")
    model = toxicity.train(frame, labels)
    staying = [r for r in staying if model.probability(model.evidence(toxicity.tokens(r[1].encode()))) < 0.5]
    sets = {}
    for key, text, _ in staying:
        if key is not None:
            sets.setdefault(key, []).append(shingles(text))
    near = [(a, b) for a, b in combinations(sets, 2) if any(len(x & y) >= 0.8 * len(x | y) for x in sets[a] for y in sets[b])]
    least = least_reachable(sets, near)
    first = {}
    for r in staying:
        if r[0] is not None and least[r[0]] == r[0]:
            first[r[0]] = min(first.get(r[0], r), r, key=lambda r: r[1])
    staying = [*first.values(), *(r for r in staying if r[0] is None)]
    copies = {r.doc_id: r.copies for r in mixing.mix_sources(spark.createDataFrame(staying, "doc_id long, text string, source string")).collect()}
    tokenizer = Tokenizer.from_file(tokenizer_path("word_bpe_49k.json"))
    return Counter((key, len(tokenizer.encode(text, add_special_tokens=False).ids) + 1) for key, text, _ in staying for _ in range(copies[key]))


@pytest.mark.parametrize("kind", ["awkward", "given", "empty", "no labels"])
def test_pipeline_is_its_plain_stages(spark, sf_dir, tmp_path, kind):
    import corpus_pipeline

    random = np.random.default_rng(2)
    prose = lambda n: " ".join("".join(chr(97 + int(i) // p % 26) for p in (1, 26, 676)) for i in random.integers(0, 4000, n)) + "."
    rows = []
    if kind in ("awkward", "no labels"):
        bodies = [prose(120) for _ in range(30)]
        near = bodies[3].split()
        near[40] = "edited"
        texts = [*bodies, bodies[0], bodies[0], " ".join(near), None, "", "  \n", prose(3000), "A | B | C | D\n" + prose(80), ("vile " * 6 + prose(30)) * 2]
        rows = [(i, t, "en", (None, "s1", "s2")[i % 3], len(t or "")) for i, t in enumerate(texts)] + [(7, bodies[7], "en", "s1", 1), (None, prose(60), None, None, None), (-4, bodies[5], None, "s9", 1)]
    given = spark.read.parquet(f"{sf_dir}/documents.parquet")
    documents = given if kind == "given" else spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    # extra columns with clashing names
    documents = documents.withColumn("copies", F.lit(1)).withColumn("own", F.lit("x")).withColumn("kept_id", F.lit(2)).withColumn("salt", F.lit("y"))
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet") if kind == "given" else spark.createDataFrame([(35, 0, 1), (1, 1, 0), (2, 1, 0), (None, 1, 1), (4, 0, None)][: 0 if kind in ("no labels", "empty") else 5], "doc_id long, quality int, toxic int")
    folder = str(tmp_path / "in")
    documents.write.parquet(f"{folder}/documents.parquet")
    labels.write.parquet(f"{folder}/labels.parquet")
    out = corpus_pipeline.run(spark, folder).collect()
    plain = [(r.doc_id, r.text, r.source) for r in documents.collect()]
    want = plain_pipeline(plain, labels, spark) if plain else Counter()
    total = Counter()
    for p in out:
        total[p.doc_id] += p.length
    assert total == sum((Counter({k: n * m}) for (k, n), m in want.items()), Counter())
    assert {(p.doc_id, p.doc_tokens) for p in out} == set(want) and (want or not plain)


def test_pipeline(spark, sf_dir):
    import corpus_pipeline

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    before = docs
    for name, stage in corpus_pipeline.STAGES[:-1]:
        after = stage(spark, before, sf_dir)
        assert after.schema.simpleString() == docs.schema.simpleString(), name
        assert after.join(before, "doc_id", "left_anti").count() == 0
        before = after
    out = corpus_pipeline.run(spark, sf_dir)
    assert out.select("doc_id").distinct().count() == before.select("doc_id").distinct().count()


def python_at_once(df):
    """The most Python operators of the plan that one task runs at once."""

    def of(node):
        name, children = node.nodeName(), node.children()
        if name == "AdaptiveSparkPlan":
            return of(node.initialPlan())
        below = [of(children.apply(i)) for i in range(children.size())]
        worst, own = max((w for w, _ in below), default=0), [n for _, n in below]
        if "Exchange" in name:
            return worst, 0
        n = (max(own) if name == "Union" else sum(own)) + bool(re.search("InArrow|InPandas|Python", name))
        return max(worst, n), n

    return of(df._jdf.queryExecution().executedPlan())[0]


def test_pipeline_tasks_run_one_python_operator(spark, sf_dir, monkeypatch):
    """Two in one task take two Python workers a core, and an executor keeps all four with what they hold."""
    import corpus_pipeline
    from storepulse.operators import components
    from storepulse.plans import lineage

    seen = []

    def noted(df, what="cut"):
        seen.append((what, python_at_once(df)))
        return lineage.cut(df, what)

    for module in (corpus_pipeline, simhash, toxicity, components):
        monkeypatch.setattr(module, "cut", noted)
    corpus_pipeline.run(spark, sf_dir)
    assert {"quality", "wide", "edges", "packing"} <= {what for what, _ in seen}
    assert max(n for _, n in seen) == 1, seen

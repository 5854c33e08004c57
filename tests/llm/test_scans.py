import random

import numpy as np
import public_tokenizers
import pytest

from assetloom.llm import license_scan, queries, token_attribution

TEMPLATES = [license_scan.Template(n, t, 0.8) for n, t in license_scan.TEMPLATES.items()]


def lcs(a, b):
    row = [0] * (len(b) + 1)
    for x in a:
        last = 0
        for j, y in enumerate(b):
            last, row[j + 1] = row[j + 1], last + 1 if x == y else max(row[j + 1], row[j])
    return row[-1]


@pytest.mark.parametrize("name", ["mit-permission", "gpl-header", "isc-permission"])
def test_patience_reaches_edited_notices(name):
    rng = random.Random(6)
    words = license_scan.split_words(license_scan.TEMPLATES[name])[0]
    for _ in range(30):
        edited = [w if rng.random() > 0.1 else rng.choice(["foo", "the"]) for w in words if rng.random() > 0.05]
        pairs = license_scan.align(edited, words)
        assert all(edited[i] == words[j] for i, j in pairs)
        assert all(a[0] < b[0] and a[1] < b[1] for a, b in zip(pairs, pairs[1:]))
        assert len(pairs) >= 0.9 * lcs(edited, words)


def test_gaps_without_anchors_are_whole():
    """A long text of few words has no anchors; all of its common subsequence is aligned."""
    rng = random.Random(5)
    for n, m, words in ((120, 125, "ab"), (400, 300, "abcd"), (1, 50, "ab"), (2_000, 1_500, "abc")):
        a, b = (rng.choices(words, k=k) for k in (n, m))
        pairs = license_scan.common_subsequence(a, b)
        assert len(pairs) == lcs(a, b) and all(a[i] == b[j] for i, j in pairs)
        assert all(x[0] < y[0] and x[1] < y[1] for x, y in zip(pairs, pairs[1:]))
    a = rng.choices("ab", k=120)
    assert len(license_scan.align(["x", *a, "y"], [*a[:60], "q", *a[60:]])) >= 118


def plain_passages(words, template):
    """Every window is aligned, without any filter."""
    out, begin = [], 0
    while begin < len(words):
        pairs = license_scan.align(words[begin : begin + template.window], template.words) if words[begin] in template.words else []
        if len(pairs) >= template.need:
            out.append((begin + pairs[0][0], begin + pairs[-1][0], len(pairs)))
            begin += pairs[-1][0]
        begin += 1
    return out


def test_filters_lose_nothing(texts):
    rng = random.Random(2)
    some = [license_scan.split_words(t)[0][:400] for t in list(texts.values())[:30]]
    listed = [license_scan.split_words(t)[0] for t in license_scan.TEMPLATES.values()]
    for own in listed:
        own = [w if rng.random() > 0.12 else rng.choice(own) for w in own for _ in range(1 + (rng.random() > 0.95)) if rng.random() > 0.06]
        some.append(rng.choice(some[:30])[:20] + own + ["and", "the", "software"] + rng.choice(listed)[:30])
    some.append(rng.choices(listed[10], k=300))
    hits = 0
    for words in some:
        for template in TEMPLATES:
            found = template.passages(words)
            assert found == plain_passages(words, template)
            hits += len(found)
            window = [w for w in words[: template.window] if w in template.places]
            bits = [template.places[w] for w in window]
            assert template.common(bits, 0, len(bits)) == lcs(window, template.words)
    assert hits >= 20


def test_license_bodies():
    for name in ("mit", "isc", "bsd-2-clause", "bsd-3-clause", "zlib", "unlicense-body"):
        text = "Some words before.\n" + license_scan.TEMPLATES[name].replace("software", "program", 2) + "\nAnd some after."
        assert [f[0] for f in license_scan.find_licenses(text, TEMPLATES)] == [name]


def test_license_ties(spark):
    """Two templates of one text: the first by name stays; repeated rows give repeated passages."""
    frame = spark.createDataFrame([(1, "Released under the MIT License.")] * 2 + [(None, "released under the mit license")], "doc_id long, text string")
    both = {"b": "Released under the MIT License", "a": "released under the mit license"}
    rows = license_scan.scan_licenses(frame, templates=both).collect()
    assert sorted((str(r["doc_id"]), r["license"]) for r in rows) == [("1", "a"), ("1", "a"), ("None", "a")]


def test_all_passages_of_a_text():
    text = "é Released under the MIT License. Released UNDER the mit license!\nAll rights reserved. " + license_scan.TEMPLATES["mit-permission"].replace("sell", "rent")
    found = license_scan.find_licenses(text, TEMPLATES)
    assert [f[0] for f in found] == ["mit-notice", "mit-notice", "all-rights-reserved", "mit-permission"]
    assert text[found[0][1] : found[0][2]] == "Released under the MIT License"
    assert license_scan.find_licenses("we released the dog under a bridge, no license", TEMPLATES) == []


def test_query_finds_every_planted_notice(spark, documents, texts):
    rows = license_scan.scan_licenses(documents).collect()
    short = ("mit-notice", "apache-2.0-notice", "gpl-3.0-notice", "cc-by-nc-4.0-notice", "all-rights-reserved")
    for name in short:
        want = {i for i, t in texts.items() if license_scan.TEMPLATES[name] in t}
        assert want <= {r["doc_id"] for r in rows if r["license"] == name}
    assert all(texts[r["doc_id"]][r["start"] : r["end"]] == r["passage"] and r["coverage"] >= 0.8 for r in rows)


def test_license_messy(messy):
    rows = license_scan.scan_licenses(messy).collect()
    assert [(r["doc_id"], r["license"]) for r in rows] == [(10, "mit-notice")]
    assert license_scan.scan_licenses(messy.limit(0)).count() == 0


RANKS = queries.tokenizer_path("byte_bpe_50k.tiktoken")


@pytest.fixture(scope="module")
def tokenizer():
    return token_attribution.RankTokenizer(RANKS, public_tokenizers.PATTERN)


def plain_count(sizes, start, stop, rule):
    at, count, crossing = 0, 0.0, 0
    for size in sizes:
        s, e = at, at + size
        at = e
        both = min(e, stop) - max(s, start)
        if both > 0:
            crossing += s < start or e > stop
            count += {"start": start <= s < stop, "end": start < e <= stop, "split": both / size}[rule]
    return count, crossing


@pytest.mark.parametrize("rule", token_attribution.RULES)
def test_attribution(tokenizer, texts, rule):
    rng = random.Random(9)
    for text in [*[t[:300] for t in list(texts.values())[:25]], "", "\n\n\n", "a\n\n b", "é\nü \n\n", " \n \n", "日本\n語"]:
        raw = text.encode()
        sizes = [int(tokenizer.sizes[i]) for i in tokenizer.encoding.encode_ordinary(text)]
        cuts = np.sort(np.array([[rng.randint(0, len(raw)), rng.randint(0, len(raw))] for _ in range(12)]), axis=1)
        lines = np.stack(token_attribution.line_spans(raw), axis=1)
        for spans in (cuts, lines):
            tokens, crossing = token_attribution.attribute(tokenizer.ends(raw), spans[:, 0], spans[:, 1], rule)
            for k, (a, b) in enumerate(spans):
                assert (tokens[k], crossing[k]) == pytest.approx(plain_count(sizes, a, b, rule))
        tokens, _ = token_attribution.attribute(tokenizer.ends(raw), lines[:, 0], lines[:, 1], rule)
        assert tokens.sum() == pytest.approx(len(sizes))


def test_lines_share_out_all_tokens(documents, texts, tokenizer):
    out = token_attribution.count_tokens(documents, RANKS, public_tokenizers.PATTERN).collect()
    total, at = {}, {}
    for r in out:
        total[r["doc_id"]] = total.get(r["doc_id"], 0) + r["n_tokens"]
        at.setdefault(r["doc_id"], []).append((r["start"], r["end"]))
        assert "\n" not in texts[r["doc_id"]][r["start"] : r["end"] - 1]
    for i, text in texts.items():
        assert total[i] == len(tokenizer.encoding.encode_ordinary(text))
        assert sorted(at[i])[0][0] == 0 and sorted(at[i])[-1][1] == len(text)


def test_fields(spark, tokenizer):
    rows = spark.createDataFrame([(1, "é title", "body text here"), (2, None, "x"), (3, "", "")], "doc_id long, title string, body string")
    text, spans = token_attribution.joined_fields(["title", "body"])
    out = token_attribution.count_tokens(rows.select("doc_id", text.alias("text"), spans.alias("spans")), RANKS, public_tokenizers.PATTERN, spans="spans", rule="split")
    got = {(r["doc_id"], r["section"]): r for r in out.collect()}
    assert got[1, "body"]["start"] == 8 and got[1, "body"]["n_tokens"] == pytest.approx(len(tokenizer.encoding.encode_ordinary("body text here")))
    assert got[1, "title"]["n_tokens"] == pytest.approx(len(tokenizer.encoding.encode_ordinary("é title")))
    assert got[2, "title"]["n_tokens"] == 0 and got[3, "body"]["n_tokens"] == 0


def test_token_counts_messy(messy):
    out = token_attribution.count_tokens(messy, RANKS, public_tokenizers.PATTERN)
    assert out.where("doc_id in (2, 3)").select("n_tokens").distinct().collect() == [(0,)]
    assert out.where("doc_id = 10").count() == 4
    assert token_attribution.count_tokens(messy.limit(0), RANKS, public_tokenizers.PATTERN).count() == 0

import random
import re
import time
from collections import Counter

import regex

from lexistrata.llm.licenses import TEMPLATES, Scanner, bigrams, scan_licenses, words_of
from lexistrata.llm.queries import op6_license_scan


def plain_scan(text, templates=TEMPLATES, threshold=0.8):
    """Every window of words of every text, without bounds on sizes or common bigrams; the best end of each begin, the longest of
    equals; then the best first, without those that overlap it."""
    lines = [" " * len(x) if re.match(r"(?i)\W*(copyright|\(c\)|©).*\d{4}", x) else x for x in text.split("\n")]
    found = [(m.group().lower(), *m.span()) for m in regex.finditer(r"[\p{L}\p{N}]+(?:[.\-][\p{L}\p{N}]+)*", "\n".join(lines))]
    words, hits = [w for w, _, _ in found], []
    for name, t in templates:
        want = bigrams(words_of(t))
        n = want.total()
        if not n:
            continue
        for i in range(len(words)):
            if n == 1 and (words[i], "") in want:
                hits.append((-1.0, -1, i, name))
            seen, common, best = Counter(), 0, (0, 0)
            for j in range(i + 1, len(words)):
                pair = (words[j - 1], words[j])
                seen[pair] += 1
                common += seen[pair] <= want[pair]
                score = 2 * common / (j - i + n)
                if 2 * n / (j - i + n) < threshold:
                    break
                best = max(best, (score, j - i + 1))
            if best[0] >= threshold:
                hits.append((-best[0], -best[1], i, name))
    kept = []
    for score, n, i, name in sorted(hits):
        if all(i - n <= a or b <= i for a, b, _, _ in kept):
            kept.append((i, i - n, name, -score))
    return [(name, score, found[a][1], found[b - 1][2]) for a, b, name, score in sorted(kept)]


def test_windows_equal_brute_force():
    rnd = random.Random(1)
    for threshold in (0.5, 0.8, 1.0):
        scanner = Scanner(threshold=threshold)
        for _ in range(25):
            parts = []
            for _ in range(rnd.randint(1, 3)):
                words = rnd.choice(TEMPLATES[1:4] + TEMPLATES[6:9] + TEMPLATES[14:])[1].split()
                a = rnd.randint(0, len(words) // 4)
                parts.append(" ".join(w for w in words[a : len(words) - rnd.randint(0, len(words) // 4)] if rnd.random() > 0.04))
                parts.append(" ".join(rnd.choice(["the", "license", "of", "mit", "a", "work", "Copyright (c) 2001 me"]) for _ in range(rnd.randint(0, 12))))
            text = rnd.choice(["\n", " ", ". "]).join(parts)
            assert scanner.scan(text) == plain_scan(text, threshold=threshold)


def test_found_inside_a_line_and_by_any_words():
    """A whole licence between thousands of words of one line; a caller's template of words that no list knows."""
    mit = TEMPLATES[0][1].replace("\n", " ")
    text = "lorem ipsum " * 1500 + mit + " dolor sit" * 1500
    ((name, score, a, b),) = Scanner().scan(text)
    assert name == "MIT" and score == 1.0 and text[a:b] == mit.rstrip(".")
    own = Scanner([("Own", "alpha beta gamma delta epsilon"), ("One", "zeta")])
    assert [(h[0], h[1]) for h in own.scan("x y. Here alpha beta gamma delta epsilon goes on, zeta too")] == [("Own", 1.0), ("One", 1.0)]
    assert Scanner([]).scan("alpha") == []


def test_many_notices_take_linear_time():
    scanner = Scanner()
    took = []
    for n in (2000, 8000):
        text = "Released under the MIT License.\n" * n
        began = time.perf_counter()
        assert len(scanner.scan(text)) == n
        took.append(time.perf_counter() - began)
    assert took[1] < 9 * took[0]


def test_every_template_is_found():
    for name, text in TEMPLATES:
        for around in ("{}", "Some prose here.\n\n{}\n\nMore prose.", "Prose\n{}"):
            (hit,) = Scanner().scan(around.format(text))
            assert hit[0] == name and hit[1] >= 0.95


def test_lines_and_sentences():
    scan = Scanner().scan
    (hit,) = scan("Long prose of many words that goes on. Released under the MIT License. It goes on for longer.\nmore")
    assert hit[0] == "MIT"
    assert [h[0] for h in scan("x\nLicensed under CC BY-NC 4.0.\ny\nLicensed under the Apache License, Version 2.0.")] == ["CC-BY-NC-4.0", "Apache-2.0"]
    mit = TEMPLATES[0][1]
    (hit,) = scan("Copyright (c) 2020 Somebody\n\n" + mit)
    assert hit[:2] == ("MIT", 1.0)
    assert scan("") == scan("the license of life") == scan("\n\n") == []


def test_operator(spark):
    rows = [(1, None), (2, ""), (None, "Released under the MIT License."), (3, "a " * 100_000), (3, "z\nLicensed under CC BY 4.0.")]
    df = spark.createDataFrame([(t, i, "clash") for i, t in rows], "text string, doc_id long, matches string")
    out = [(r.doc_id, [tuple(m) for m in r.matches]) for r in scan_licenses(df).collect()]
    assert out == [(1, []), (2, []), (None, [("MIT", 1.0, 0, 30)]), (3, []), (3, [("CC-BY-4.0", 1.0, 2, 26)])]
    assert scan_licenses(df.limit(0)).collect() == []


def test_query_equals_brute_force(spark, tmp_path):
    """The whole query on a table of documents with and without notices."""
    d = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{d}/documents.parquet").where("n_chars < 3000")
    some = docs.where("lower(text) like '%licen%'").limit(40).unionByName(docs.limit(60)).select("doc_id", "text").collect()
    more = [(100_000 + i, f"{t}\n\nCopyright 2020 Someone\n{t.upper()} and more") for i, (_, t) in enumerate(TEMPLATES)] + [(None, None), (200_000, "")]
    spark.createDataFrame([(r.doc_id, r.text) for r in some] + more, "doc_id long, text string").coalesce(1).write.parquet(str(tmp_path / "documents.parquet"))
    want = []
    for i, t in [*((r.doc_id, r.text) for r in some), *more]:
        hits = plain_scan(t or "")
        best = max(((s, n) for n, s, _, _ in hits), default=(None, None))
        want.append((i, len(hits), ",".join(sorted({h[0] for h in hits})), best[1], best[0]))
    got = [tuple(r) for r in op6_license_scan(spark, str(tmp_path)).collect()]
    assert sorted(got, key=str) == sorted(want, key=str) and sum(w[1] > 0 for w in want) > 20

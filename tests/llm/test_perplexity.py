import math
import random
import re
from collections import Counter, defaultdict

import pytest
import xxhash

from gristmill.llm import perplexity, queries

DOCS = "doc_id long, text string, lang string, kept int, _text string"
WORD = re.compile(r"[^\x20\x09-\x0D]+")


def fold(text):
    return xxhash.xxh64((text or "").encode(), seed=42).intdigest() & 1


def grams_of(text):
    for w in WORD.findall(text or ""):
        padded = f" {w}\n"
        for i in range(1, len(padded)):
            yield padded[max(0, i - 4) : i + 1]


class Model:
    """Interpolated modified Kneser-Ney, n-gram by n-gram."""

    def __init__(self, longest, letters):
        self.counts, self.even = [Counter() for _ in range(6)], 1 / (letters + 1)
        for g, n in longest.items():
            self.counts[len(g)][g] += n
        for k in range(5, 1, -1):
            for g in self.counts[k]:
                self.counts[k - 1][g[1:]] += 1
        self.discounts = []
        for c in self.counts:
            n = Counter(c.values())
            y = n[1] / (n[1] + 2 * n[2]) if n[1] + n[2] else 0.5
            self.discounts.append([0.0] + [min(max(i - (i + 1) * y * (n[i + 1] / n[i] if n[i] else 0.5), 0.05), i - 0.05) for i in (1, 2, 3)])
        self.after = defaultdict(list)
        for c in self.counts:
            for g, n in c.items():
                self.after[g[:-1]].append(n)

    def chance(self, gram):
        if not gram:
            return self.even
        d, seen = self.discounts[len(gram)], self.after.get(gram[:-1], [])
        if not seen:
            return self.chance(gram[1:])
        n = self.counts[len(gram)][gram]
        return (n - d[min(n, 3)] + sum(d[min(x, 3)] for x in seen) * self.chance(gram[1:])) / sum(seen)


def statistics(text):
    text = text or ""
    words = WORD.findall(text)
    windows = Counter(zip(words, words[1:], words[2:], strict=False))
    again = {i + k for i in range(len(words) - 2) if windows[tuple(words[i : i + 3])] > 1 for k in range(3)}
    lines = [x for x in text.split("\n") if WORD.search(x)]
    return len(words), sum(map(len, words)), sum(text.count(c) for c in "#*$%&|<>"), len(lines) - len(set(lines)), len(again)


def expected(rows, spread=perplexity.SPREAD):
    longest, letters = defaultdict(Counter), defaultdict(set)
    for _, text, lang in rows:
        longest[lang or "", fold(text)].update(grams_of(text))
        for g in grams_of(text):
            letters[lang or ""].add(g[-1])
    models = {}
    found, steps = [], defaultdict(list)
    for doc_id, text, lang in rows:
        key = (lang or "", 1 - fold(text))
        if key not in models:
            models[key] = Model(longest[key], len(letters[lang or ""]))
        stats = statistics(text)
        logs = [math.log(models[key].chance(g)) for g in grams_of(text)]
        score = -sum(logs) / len(logs) if logs else None
        failed = stats[0] < 50 or 100 * stats[4] > 50 * stats[0]
        found.append((doc_id, *stats, failed, score, lang or ""))
        if not failed:
            steps[lang or ""].append(math.floor(score * 1024))
    band = {}
    for lang, s in steps.items():
        s.sort()
        a, b = (s[math.ceil(q * len(s)) - 1] for q in (0.25, 0.75))
        band[lang] = ((a - spread * (b - a + 1)) / 1024, (b + 1 + spread * (b - a + 1)) / 1024)
    for *row, failed, score, lang in found:
        low, high = band.get(lang, (1, 0))
        yield (*row, failed, not failed and low <= score <= high, score)


def some_docs(draw, n):
    pieces = {"en": ["th", "er", "in", "an", "ou", "the", "of"], "fr": ["é", "eau", "le", "ou", "ç", "ment"], None: ["x", "y", "zz"]}
    for i in range(n):
        lang = draw.choice(["en", "en", "fr", None])
        source = pieces[draw.choice(["en", "fr"])] if draw.random() < 0.05 else pieces[lang]
        words = ["".join(draw.choice(source) for _ in range(draw.randint(1, 4))) for _ in range(draw.choice([0, 3, 49, 50, 60, 120]))]
        if draw.random() < 0.15:
            words = ["qx#%" + chr(draw.randint(0x4E00, 0x9000)) * draw.randint(1, 5) for _ in words]
        if draw.random() < 0.1:
            words = words[:3] * (len(words) // 3)
        yield i, "".join(w + draw.choice([" ", " ", "\t", "\n", "\n\n"]) for w in words), lang


EDGES = [(900, None, "en"), (901, "", "fr"), (902, " \n\t", None), (903, "lone " * 60, "xx"), (904, "a b c a b c x\ny\n\nx\n x", "en"), (None, "the " * 3, "en"), (905, "#*$%&|<>" * 9, "en"), (906, "w" * 5000 + " ok", "en"), (907, "\x01\U0001f600 é" * 40, "en")]


def same(got, want):
    close = lambda a, b: a == b or a is not None and b is not None and abs(a - b) < 1e-5
    return len(got) == len(want) and all(g[:-1] == w[:-1] and close(g[-1], w[-1]) for g, w in zip(got, want, strict=True))


def test_query_equals_brute_force(spark, tmp_path):
    rows = [*some_docs(random.Random(4), 150), *EDGES]
    rows += [rows[7], (8000, *rows[7][1:])]
    spark.createDataFrame([(*r, 5, "mine") for r in rows], DOCS).repartition(5).write.parquet(f"{tmp_path}/documents.parquet")
    found = queries.op12_quality_rules(spark, str(tmp_path))
    got = sorted((tuple(r)[:9] for r in found.collect()), key=str)
    want = sorted((r[:8] + (None if r[8] is None else round(r[8], 6),) for r in expected(rows)), key=str)
    assert same(got, want)
    assert {(r[6], r[7]) for r in want} == {(True, False), (False, True), (False, False)}


def test_joined_models_give_the_same(spark):
    rows = [(*r, 5, "mine") for r in [*some_docs(random.Random(9), 60), *EDGES]]
    docs = spark.createDataFrame(rows + rows[:5], DOCS)
    one, other = (sorted(map(tuple, perplexity.scored(docs, most).collect()), key=str) for most in (1 << 20, 0))
    assert same(one, other)


def test_chances_of_a_context_sum_to_one(spark):
    docs = spark.createDataFrame([(*r, 5, "mine") for r in some_docs(random.Random(1), 40)], DOCS)
    grams = perplexity.levels(perplexity.gram_counts(docs)).where("lang = 'en'").collect()
    letters = {r.gram for r in grams if len(r.gram) == 1}
    model = Model({r.gram: r.c0 for r in grams if r.c0 and (len(r.gram) == 5 or r.gram[0] == " ")}, len(letters))
    for k in range(1, 6):
        assert {r.gram: r.c0 for r in grams if len(r.gram) == k and r.c0} == +model.counts[k]
    for context in ["", "t", " t", "the", "xxxx"]:
        assert abs(sum(model.chance(context + x) for x in letters) + model.chance(context + "\0") - 1) < 1e-9


def test_columns_and_empty_tables(spark):
    docs = spark.createDataFrame([(*r, 5, "mine") for r in EDGES], DOCS)
    assert perplexity.judge(docs).columns == ["doc_id", "text", "lang", "_text", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "log_perplexity", "base_failed", "lower", "upper", "kept"]
    assert perplexity.judge(docs.limit(0)).collect() == []
    assert perplexity.judge(docs.select("text")).where("kept").count() == 0
    with pytest.raises(ValueError):
        perplexity.judge(docs.select("doc_id"))

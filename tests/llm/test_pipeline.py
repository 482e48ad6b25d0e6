"""The pipeline against each stage written out by hand, and its stages on odd tables."""

import hashlib

import pytest
import xxhash

import corpus_pipeline
from tests.llm.fixtures import PASSAGE, documents, prose
from tests.llm.test_operators import CODER, WORD, brute_language, brute_model, brute_secrets

SF = "/root/testdata/sf0.001"


def redacted(text):
    """Overlapping spans become one mark."""
    out, at, spans = "", 0, sorted((s, e) for _, s, e in brute_secrets(text))
    merged = []
    for s, e in spans:
        if merged and s < merged[-1][1]:
            merged[-1][1] = max(merged[-1][1], e)
        else:
            merged.append([s, e])
    for s, e in merged:
        out, at = out + text[at:s] + "[REDACTED]", e
    return out + text[at:]


def one_of_each(rows):
    """Of texts linked at two bits or fewer the smallest id stays."""
    prints = {}
    for i, t in rows.items():
        w = WORD.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or ""))
        h = [xxhash.xxh64_intdigest(" ".join(w[k : k + 3]).encode(), 42) for k in range(max(len(w) - 2, min(len(w), 1)))]
        prints[i] = sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))
    group = {i: i for i in rows}
    for a in sorted(rows):
        for b in sorted(rows):
            if b < a and (prints[a] ^ prints[b]).bit_count() <= 2 and group[a] != group[b]:
                old, new = max(group[a], group[b]), min(group[a], group[b])
                group = {i: new if g == old else g for i, g in group.items()}
    return {i: t for i, t in rows.items() if group[i] == i}


def leaks(text, items):
    """Whether a window of an item's length (or the whole text, if shorter) has weighted similarity 0.8."""
    from collections import Counter

    words = text.lower().split()
    for item in items:
        n = min(5, len(item))
        want = Counter(tuple(item[k : k + n]) for k in range(len(item) - n + 1))
        span = min(len(words), len(item))
        grams = [tuple(words[k : k + n]) for k in range(len(words) - n + 1)]
        if not want or not any(g in want for g in grams):
            continue
        width = span - n + 1
        for s in range(len(grams) - width + 1):
            have = Counter(grams[s : s + width])
            both = sum((want & have).values())
            if both / (want.total() + width - both) >= 0.8:
                return True
    return False


def test_run_equals_the_stages_by_hand(spark):
    docs = [(r["doc_id"], r["lang"], r["text"]) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    items = [(r["text"] or "").lower().split() for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    model = brute_model(docs)
    rows = one_of_each({i: t for i, _, t in docs if brute_language(model, t)[2]})
    expected = {}
    for i, t in rows.items():
        if not leaks(t, items):
            clean = redacted(t)
            expected[i] = (CODER.encode_ordinary(clean), hashlib.sha256(clean.encode()).hexdigest())
    got = {r["doc_id"]: (list(r["ids"]), r["decoded_sha256"]) for r in corpus_pipeline.run(spark, SF).collect()}
    assert got == expected and 0 < len(got) < len(docs)


STAGES = dict(corpus_pipeline.STAGES)
#: Null, empty and repeated rows, one id with two texts, a null id, a copy, a benchmark item and a secret.
ODD = [(None, None), (None, "null id " + prose(60, 4)), (1, prose(80, 5)), (1, prose(80, 5)), (1, prose(70, 6)), (2, ""), (3, None), (4, prose(80, 5)), (5, " ".join(["so", PASSAGE, "it"])), (5, prose(50, 8)), (6, "token=abcdefghijklmnop " + prose(30, 9)), (7, "123 456")]


@pytest.fixture(scope="module")
def tables(spark, tmp_path_factory):
    folder = tmp_path_factory.mktemp("tables")
    spark.createDataFrame([(0, PASSAGE), (1, None), (2, "")], "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")
    return str(folder)


def ids(df):
    return sorted((str(r["doc_id"]), str(r["text"])) for r in df.collect())


@pytest.mark.parametrize("name", list(STAGES))
def test_stages_on_empty_tables(spark, tables, name):
    docs = documents(spark, [])
    out = STAGES[name](spark, docs, tables)
    assert out.collect() == [] and (name == "bpe" or out.columns == docs.columns)


def test_stages_on_odd_rows(spark, tables):
    docs = documents(spark, ODD)
    out = {name: stage(spark, docs, tables) for name, stage in STAGES.items()}
    assert all(out[n].columns == docs.columns for n in out if n != "bpe")
    assert ids(out["language"]) == []  # no labels, no model
    every = [(str(i), str(t)) for i, t in ODD]
    copies = [("1", prose(80, 5)), ("1", prose(80, 5)), ("4", prose(80, 5)), ("2", ""), ("3", "None"), ("None", "None")]
    assert ids(out["near_duplicates"]) == sorted([x for x in every if x not in copies] + [("1", prose(80, 5)), ("2", "")])
    assert ids(out["decontamination"]) == sorted(x for x in every if PASSAGE not in x[1])
    assert ids(out["secrets"]) == sorted((i, t.replace("token=abcdefghijklmnop", "[REDACTED]")) for i, t in every)
    coded = sorted((str(r["doc_id"]), list(r["ids"])) for r in out["bpe"].collect())
    assert coded == sorted((str(i), CODER.encode_ordinary(t or "")) for i, t in ODD)


def test_language_stage_goes_by_the_labels(spark, tables):
    rows = [(i, "xx" if i % 2 else "yy", " ".join(["wala holu mi kan"] * 9 if i % 2 else ["strung brecht ort fuld"] * 9)) for i in range(40)] + [(90, None, None), (91, None, "42"), (92, None, "wala kan mi holu wala mi holu wala kan")]
    docs = spark.createDataFrame(rows, "doc_id long, lang string, text string")
    kept = {r["doc_id"] for r in STAGES["language"](spark, docs, tables).collect()}
    assert kept == {*range(40), 92}


def test_order_of_the_stages():
    assert [n for n, _ in corpus_pipeline.STAGES] == ["language", "near_duplicates", "decontamination", "secrets", "bpe"]

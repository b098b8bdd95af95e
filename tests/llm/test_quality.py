import re
from collections import Counter

from docloom.llm.quality import POLICIES, RULES, ablations, apply_policy, ledger, mask_of


def brute(text):
    text = text or ""
    w = re.findall(r"[^\x20\x09-\x0D]+", text)
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    grams = Counter(tuple(w[i : i + 3]) for i in range(len(w) - 2))
    places = {p for i in range(len(w) - 2) if grams[tuple(w[i : i + 3])] > 1 for p in range(i, i + 3)}
    m = {
        "n_words": len(w), "word_chars": sum(map(len, w)), "n_symbols": sum(c in "#*$%&|<>" for c in text), "n_lines": len(lines),
        "n_dup_lines": len(lines) - len(set(lines)), "n_repeat_words": len(places),
    }
    failures = sum(1 << k for k, rule in enumerate(RULES.values()) if eval(rule, {}, m))
    return (*m.values(), failures)


TEXTS = [
    None, "", " \n\t", "a", "a b c", "a b c a b c", "x " * 200, "a b c d\na b c d\n\na b c d", "###  %% a", "é\U0001f600 ß\n" * 60, "word " * 60_000,
    " ".join(f"w{i}" for i in range(80)), " ".join("abcdefghijklmnopqrstuvwxyz" + str(i) for i in range(60)), "a\x0bb\x0cc\r\nd", "a b c",
]


def test_measurements_and_bits(spark):
    df = spark.createDataFrame(list(enumerate(TEXTS)), "doc_id long, text string").selectExpr("*", "1 as n_words", "2 as failures", "3 as n")
    rows = ledger(df).collect()
    for r in rows:
        got = (r.n_words, r.word_chars, r.n_symbols, r.n_lines, r.n_dup_lines, r.n_repeat_words, r.failures)
        assert got == brute(TEXTS[r.doc_id]), (r.doc_id, got, brute(TEXTS[r.doc_id]))
    assert len(rows) == len(TEXTS) and ledger(df.where("false")).collect() == []


def test_policies_and_ablations(spark):
    led = ledger(spark.createDataFrame(list(enumerate(TEXTS * 2)), "doc_id long, text string"))
    masks = [brute(t)[-1] for t in TEXTS * 2]
    for version, rules in POLICIES.items():
        policy = mask_of(rules)
        assert sorted(r.kept for r in apply_policy(led, version).collect()) == sorted(m & policy == 0 for m in masks)
        got = {r.rule: (r.n_failed, r.n_alone, r.n_kept_without) for r in ablations(led, version).collect()}
        for rule in rules:
            bit = mask_of((rule,))
            own = [m & policy for m in masks]
            assert got[rule] == (sum(m & bit > 0 for m in own), sum(m == bit for m in own), sum(m & ~bit == 0 for m in own))
    assert ablations(led.where("false")).collect() == []

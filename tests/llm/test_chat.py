import hashlib

from docloom.llm.chat import rotate_perspectives


def brute(rows, part):
    groups = {}
    for conv, turn, role, text in rows:
        groups.setdefault(conv, []).append((turn, role, text or ""))
    out = []
    for conv, turns in groups.items():
        turns.sort(key=lambda t: (t[0] is not None, t[0] or 0, t[1] is not None, t[1] or "", hashlib.md5(t[2].encode()).hexdigest()))
        for who in sorted({r for _, r, _ in turns if r is not None and r != "system"}):
            for k in range(0, len(turns), part):
                text, masks = "", []
                for _, role, body in turns[k : k + part]:
                    text += "<|assistant|>\n" if role == who else "<|system|>\n" if role in (None, "system") else f"<|user name={role}|>\n"
                    start = len(text)
                    text += body + "<|end|>\n"
                    if role == who:
                        masks.append((start, len(text)))
                out.append((conv, k // part, who, len(turns[k : k + part]), text, masks, sum(b - a for a, b in masks)))
    return sorted(out, key=str)


def test_every_perspective(spark):
    rows = [(1, 0, "system", "be kind"), (1, 1, "ann", "hé"), (1, 2, "bob", None), (1, 3, "ann", "bye"), (1, 3, "ann", "bye"), (1, 3, "bob", "tie")]
    rows += [(2, 0, "system", "alone"), (3, None, "ann", "x"), (3, 5, None, "no role"), (None, 0, "ann", "null id"), (4, 0, "ann", "long " * 50_000)]
    rows += [(5, i, "ann" if i % 2 else "bob", f"t{i}") for i in range(20)] + [(6, 0, "cat", "speaks once, at the start")] + [(6, i, "ann", "goes on") for i in range(700)]
    rows += [(7, 3, "ann", "the same turn")] * 300 + [(None, None, None, None)]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").selectExpr("*", "1 as part", "'x' as participant", "2 as place", "3 as k")
    for part in (512, 8):
        got = [(r.conv_id, r.part, r.participant, r.n_turns, r.text, [tuple(m) for m in r.masks], r.n_target_chars) for r in rotate_perspectives(df, part).collect()]
        assert sorted(got, key=str) == brute(rows, part)
    assert rotate_perspectives(df.where("false")).collect() == []

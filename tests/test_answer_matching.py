import random
import re
import unicodedata

import pytest

from scholia.functions.tables import ANSWER_PREFIX
from scholia.plans import wrong_import as wi

DRAFT = "upload long, draft long, seq int, stem string, kind string, ok boolean"
ENTRY = "upload long, entry long, seq int, hint string, answer array<string>, analysis string, section string"


def loose(t):
    return "".join(c for c in t if unicodedata.category(c)[0] not in "PSZ" and not c.isspace()).lower()


def key(t):
    return loose(re.sub(ANSWER_PREFIX, "", t.strip()))


def plain(drafts, entries):
    """Each entry against all drafts, one after the other."""
    out, used = [], set()
    for upload, entry, seq, hint, answer, analysis, section in sorted(entries):
        free = [d for d in drafts if d[0] == upload and (upload, d[1]) not in used]
        h = key(hint)
        h = h if len(h) >= 4 else ""
        same = [d for d in free if h and key(d[3]) == h]
        scores = []
        for _, draft, no, stem, kind, ok in free:
            k, s = key(stem), 0.0
            s = 0.95 if seq > 0 and no == seq else 0.0
            if h:
                s = 0.99 if h == k else max(s, 0.94) if h in k or k in h else s
            body = loose(("\n".join(answer) + "\n" + (analysis or "")).strip())
            if s < 0.88 and k and body:
                own = {k[i : i + n] for n in (2, 3, 4) for i in range(len(k) - n + 1)}
                common = sum(body[i : i + n] in own for n in (2, 3, 4) for i in range(len(body) - n + 1))
                material = kind == "material_analysis"
                if common >= 4:
                    e = 0.86 + min(0.1, common * 0.008) + 0.03 * material + 0.03 * (material and ("案例" in section or "材料" in section))
                    s = max(s, min(e, 0.98))
            scores.append((s, draft, ok))
        scores.sort(reverse=True)
        pick = None
        if len(same) == 1:
            pick = (0.99, same[0][1], same[0][5])
        elif scores and (scores[1][0] if len(scores) > 1 else 0.0) < scores[0][0] - 0.015:
            pick = scores[0]
        if pick and pick[0] >= 0.86 and pick[2]:
            used.add((upload, pick[1]))
            out.append((upload, entry, pick[1], round(pick[0], 6)))
    return out


def found(spark, drafts, entries):
    d, e = spark.createDataFrame(drafts, DRAFT).repartition(3), spark.createDataFrame(entries, ENTRY).repartition(3)
    scores = wi.answer_scores(d, e).join(d.select("upload", "draft", "ok"), ["upload", "draft"])
    return sorted((r.upload, r.entry, r.draft, round(r.score, 6)) for r in wi.match_entries(scores).collect())


def test_cases(spark):
    drafts = [
        (1, 1, 1, "简述教师口语的基本要求", "short_answer", True), (1, 2, 2, "论述课堂提问的方法", "short_answer", True),  # a hint counts more than a number
        (2, 1, 1, "材料一讲述了某班课堂教学的过程和问题", "material_analysis", True), (2, 2, 2, "材料二讲述了某班课堂教学的过程和问题", "material_analysis", True),
        (3, 1, 5, "完全无关的题干内容", "essay", True), (3, 2, 6, "另外一道不同的题", "essay", True),
    ]
    entries = [
        (1, 10, 1, "2. 论述课堂提问的方法", ["答"], "", ""),
        (2, 10, 0, "材料二讲述了某班课堂教学的过程和问题", ["某班课堂教学的过程和问题都在材料里讲述了"], "", "案例分析"),
        (3, 10, 0, "题", ["毫不相干"], "", ""),  # a weak hint and no evidence
    ]
    assert found(spark, drafts, entries) == [(1, 10, 2, 0.99), (2, 10, 2, 0.99)] == plain(drafts, entries)


@pytest.mark.parametrize("seed", range(3))
def test_matches_plain_greedy(spark, seed):
    rng = random.Random(seed)
    words = ["river", "stone", "课堂", "教学", "planet", "题", "harbour bell", "quiet", "market", "材料"]
    say = lambda n: " ".join(rng.choice(words) for _ in range(n))
    drafts, entries = [], []
    for upload in range(4):
        stems = [say(rng.randrange(1, 7)) for _ in range(12)]
        drafts += [(upload, i, i + 1, rng.choice(["", f"第{i}题 ", "（2）"]) + rng.choice(stems), rng.choice(["essay", "material_analysis"]), rng.random() < 0.85) for i in range(14)]
        drafts.append((upload, 50, 0, "。。", "essay", True))
        for j in range(16):
            stem = rng.choice(stems)
            entries.append((upload, j, rng.choice([0, rng.randrange(1, 16)]), rng.choice(["", "x", stem, stem[:9], "see " + stem + " then"]), [rng.choice(["A", say(3), ""])], rng.choice([None, "", say(4)]), rng.choice(["", "案例分析题"])))
    got = found(spark, drafts, entries)
    assert got == sorted(plain(drafts, entries)) and len(got) > 8


def test_stale_answers_anywhere(spark):
    rng = random.Random(5)
    base = ["".join(rng.choice("abcdefg教学") for _ in range(rng.randrange(30, 150))) for _ in range(20)]
    rows = []
    for i in range(150):
        t = rng.choice(base)
        a = rng.randrange(len(t) // 2)
        rows.append((i % 3, i, rng.random() < 0.2, rng.choice([t, t[a:], t[a : a + 60], t[:50], "z" + t]), rng.randrange(5)))
    df = spark.createDataFrame(rows, "session int, draft long, by_user boolean, t string, version int").repartition(4)
    got = {r.draft for r in wi.stale_answers(df, df.where("version = 4")).collect()}
    want = {d for s, d, u, t, v in rows for s2, d2, _, n, v2 in rows if s == s2 and d != d2 and v2 == 4 and not u and len(t) >= 40 and len(n) >= 40 and (t in n or n in t) and (v <= 2 or t == n)}
    assert got == want and len(want) > 10
    assert wi.stale_answers(df.where("false"), df).count() == 0

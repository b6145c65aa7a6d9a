import hashlib
import random

import public_tokenizers
import pytest
from scholia.llm import ctph, pieces, token_counts

import brute
from test_first import KIND, rows, table, words  # noqa: F401


@pytest.fixture(scope="module")
def vocabulary():
    return pieces.Vocabulary.load(public_tokenizers.path("piece_bpe_32k.model"))


ODD = ["", " ", "  a  b\n\tc ", "ê̈½ 𝔘 日本 ﬁ", "\x00\x01", "x" * 3000, "<0x0A> <unk> <s>", "a b"]


def plain_best(own, text):
    """Quadratic Viterbi over all substrings."""
    score = {p: (s, i) for p, i, s in own.pieces}
    unknown = min(s for _, _, s in own.pieces) - pieces.PENALTY
    best = [(0.0, 0, ())] + [None] * len(text)
    for e in range(1, len(text) + 1):
        for a in range(max(0, e - 20), e):
            p = text[a:e]
            if p in score:
                x = (best[a][0] + score[p][0], (score[p][1],))
            elif e - a == 1:
                x = (best[a][0] + unknown, tuple(own.byte_ids[b] for b in p.encode()))
            else:
                continue
            if best[e] is None or x[0] > best[e][0]:
                best[e] = (x[0], a, x[1])
    out, e = [], len(text)
    while e:
        out = list(best[e][2]) + out
        e = best[e][1]
    return out, best[len(text)][0]


def test_pieces_match_a_plain_viterbi_and_read_back(vocabulary):
    coder, rng = pieces.Coder(vocabulary), random.Random(1)
    for text in [*ODD[:5], *("".join(rng.choice("the of and ing\n éz") for _ in range(60)) for _ in range(30))]:
        ids, score = coder.encode(text)
        assert coder.decode(ids) == text
        if text:
            want = plain_best(vocabulary, "▁" + text.replace(" ", "▁"))
            assert (ids.tolist(), score) == (want[0], pytest.approx(want[1]))


def test_pieces_match_the_library_in_unigram_mode(vocabulary):
    import sentencepiece
    from sentencepiece import sentencepiece_model_pb2 as pb

    model = pb.ModelProto()
    model.ParseFromString(open(public_tokenizers.path("piece_bpe_32k.model"), "rb").read())
    model.trainer_spec.model_type = pb.TrainerSpec.UNIGRAM
    for p in model.pieces:  # the library adds scores in single precision, which these placeholders would drown
        if p.type == 1 and p.score <= -1e9:
            p.score = -40000
    vocabulary.pieces = [(p, i, max(s, -40000.0)) for p, i, s in vocabulary.pieces]
    library, coder = sentencepiece.SentencePieceProcessor(model_proto=model.SerializeToString()), pieces.Coder(vocabulary)
    rng = random.Random(4)
    for _ in range(100):
        text = " ".join("".join(rng.choice("etaoinshr") for _ in range(rng.randrange(1, 9))) for _ in range(12))
        assert coder.encode(text)[0].tolist() == library.encode(text)


def test_piece_rows(spark):
    own = pieces.Vocabulary.load(public_tokenizers.path("piece_bpe_32k.model"))
    data = [(i, t) for i, t in enumerate(ODD)] + [(None, "a b"), (50, None), (3, "again")]
    docs = table(spark, data)
    got = pieces.encode(docs, own).collect()
    assert len(got) == len(data) and all(r.round_trip for r in got)
    back = {(r.doc_id, r.text) for r in pieces.decode(pieces.encode(docs, own), own).collect()}
    assert back == set(data)
    assert pieces.digest(docs, own).count() == len(data)
    assert pieces.encode(table(spark, [(1, "▁")]), own).first().round_trip is False
    assert pieces.digest(spark.createDataFrame([], KIND), own).count() == 0


def test_token_counts(spark):
    from tokenizers import Tokenizer

    file = public_tokenizers.path("word_bpe_49k.json")
    library, rng = Tokenizer.from_file(file), random.Random(8)
    data = [(i, t) for i, t in enumerate(ODD)] + [(20, None), (None, "x y"), (21, "<|endoftext|>a <|startoftext|> B" * 50)]
    data += [(30 + i, "".join(rng.choice("ab'st re.,;<|>1 \ńé日") for _ in range(5000))) for i in range(6)]
    data += [(40, "a" * 5000), (41, "a" * 3000 + " " + "b" * 3000), (42, "ab " * 3000), (43, " " * 5000), (44, "日" * 4000 + " x")]
    got = {r.doc_id: (r.n_bytes, r.n_tokens, r.over_limit) for r in token_counts.token_counts(table(spark, data), file, limit=500, chunk=300, overlap=20).collect()}
    for i, t in data:
        n = len(library.encode(t or "", add_special_tokens=False).ids)
        assert got[i] == (len((t or "").encode()), n, n > 500), i


def test_long_texts_without_white_space():
    from time import perf_counter

    from tokenizers import Tokenizer

    file = public_tokenizers.path("word_bpe_49k.json")
    library, rng = Tokenizer.from_file(file), random.Random(9)
    han = lambda n: "".join(chr(rng.randrange(0x4E00, 0x9FA0)) for _ in range(n))
    counter = token_counts.Counter(open(file, encoding="utf-8").read(), 300, 20)
    for text in (han(5000), "".join(rng.choice("éabcшщ日本𝔘Σσ") for _ in range(5000)), "a" * 5000, "".join(rng.choice("가각각éê") for _ in range(3000)), "ﬁĲ" * 1000 + han(500)):
        assert counter.count([text]) == [len(library.encode(text, add_special_tokens=False).ids)]
    big = token_counts.Counter(open(file, encoding="utf-8").read())
    text = han(320_000)
    t = perf_counter()
    want = len(library.encode(text, add_special_tokens=False).ids)
    own, t = perf_counter() - t, perf_counter()
    assert big.count([text]) == [want]
    assert perf_counter() - t < 6 * own + 1


def test_long_texts_encode_their_overlaps_only():
    from tokenizers import Tokenizer

    file = public_tokenizers.path("word_bpe_49k.json")
    library, rng = Tokenizer.from_file(file), random.Random(10)
    special = ["<|endoftext|>", "<|startoftext|>", "don't", "\u3000", "É", "日本語", " \t", "\r\n", "\x0b"]
    counter = token_counts.Counter(open(file, encoding="utf-8").read(), 300, 20)
    for _ in range(40):
        text = "".join(rng.choice(special) if rng.random() < 0.2 else rng.choice("abz 19.,;<|>' ") * rng.choice((1, 1, 1, 9)) for _ in range(rng.randrange(300, 3000)))
        text += "x" * rng.choice((0, 500)) + " " + words(rng, rng.randrange(300))
        assert counter.count([text]) == [len(library.encode(text, add_special_tokens=False).ids)]
    big, seen = token_counts.Counter(open(file, encoding="utf-8").read()), []
    tokens = big.tokens
    big.tokens = lambda part, at: seen.append(len(part)) or tokens(part, at)
    text = words(rng, 60_000, 4000)
    assert big.count([text]) == [len(library.encode(text, add_special_tokens=False).ids)]
    assert sum(seen) < len(text) / 10


def test_fingerprints_compare():
    rng = random.Random(6)
    a = words(rng, 800, 4000).encode()
    b = a[:2000] + b"something else here" + a[2100:]
    assert ctph.likeness(ctph.fingerprint(a), ctph.fingerprint(a)) == 1
    assert ctph.likeness(ctph.fingerprint(a), ctph.fingerprint(b)) > 0.85
    assert ctph.likeness(ctph.fingerprint(a), ctph.fingerprint(words(rng, 800, 4000).encode())) < 0.1
    assert ctph.likeness("3::", ctph.fingerprint(a)) == 0
    assert len(ctph.fingerprint(b"a" * 100_000)) < 300
    x, y = "ABCBDAB", "BDCABA"
    assert ctph._common(x, y) == 4


def test_fingerprints_match_a_plain_reading():
    rng = random.Random(12)
    texts = [b"", b"a", "é日".encode(), b"ab" * 900, *(words(rng, rng.randrange(1, 400), 900).encode() for _ in range(25))]
    texts += [t[: len(t) // 3] + b"changed" + t[len(t) // 3 :] for t in texts] + [t + t for t in texts[-8:]]
    marks = [ctph.fingerprint(t) for t in texts]
    assert marks == [brute.ctph(t) for t in texts]
    some = 0
    for i, x in enumerate(marks):
        for y in marks[: i + 1]:
            want = brute.likeness(x, y)
            some += 0 < want < 1
            assert ctph.likeness(x, y) == pytest.approx(want)
    assert some > 20


@pytest.mark.parametrize("parts", [1, 7])
def test_edit_report(spark, rows, parts):  # noqa: F811
    data = rows + [(None, "zz top")]
    got = ctph.edit_report(table(spark, data).repartition(parts)).collect()
    order = sorted(data, key=lambda r: (-(r[0] if r[0] is not None else -(2**63)), r[1] is not None, (r[1] or "").encode()))
    want = []
    for (i, t), (_, u) in zip(order, order[1:] + order[:1]):
        t, u = t or "", u or ""
        n = len(t) // 3
        e = (t[: len(t) - n] + u[:n]).encode()
        f = [ctph.fingerprint(x) for x in (t.encode(), e, u.encode())]
        want.append((i, len(t), hashlib.sha256(e).hexdigest(), f[0], f[1], ctph.likeness(f[0], f[1]), ctph.likeness(f[0], f[2])))
    assert sorted(map(repr, map(tuple, got))) == sorted(map(repr, want))
    single = ctph.edit_report(table(spark, [(4, "abcdef")])).collect()
    assert single[0].near_next == 1 and single[0].edited_sha256 == hashlib.sha256(b"abcdab").hexdigest()
    assert ctph.edit_report(spark.createDataFrame([], KIND)).count() == 0

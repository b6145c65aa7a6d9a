"""Cleaning, normalising and comparing text."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from scholia.functions.tables import ANSWER_PREFIX, END_WARNINGS, FOLD_FROM, FOLD_TO, FULL_WIDTH, GENERIC_SHORT, GENERIC_WORDS, GRADING_MARKS, HALF_WIDTH, MID_START, NEW_QUESTION_MARK, ONE_CAPITAL_FROM, ONE_CAPITAL_TO, PAGE_NUMBER, PRINTED_MARKER, QUESTION_START, SCOPE_MARKS, START_WARNINGS, TOPIC_PREFIX, TYPE_ALIASES

SPACES = r"(?U)\s+"


def clean_page(text: Column) -> Column:
    """Drop control characters, squeeze blanks, blank out page-number lines, drop a line equal to the one before it
    (of 4 bytes or more), and turn wide spaces into plain ones last."""
    plain = F.regexp_replace(text, r"[\x00-\x08\x0b\x0c\x0e-\x1f\x7f]", "")
    lines = F.transform(F.split(plain, "\n", -1), lambda x: F.rtrim(F.regexp_replace(x, r"[ \t]+", " ")))
    lines = F.transform(lines, lambda x: F.when(x.rlike(PAGE_NUMBER), F.lit("")).otherwise(x))
    numbered = F.transform(lines, lambda x, i: F.struct(x.alias("x"), F.when(i > 0, F.get(lines, i - 1)).alias("before")))
    kept = F.filter(numbered, lambda r: ~(r["x"].eqNullSafe(r["before"]) & (F.octet_length(F.trim(r["x"])) >= 4)))
    return F.replace(F.array_join(F.transform(kept, lambda r: r["x"]), "\n"), F.lit("　"), F.lit(" "))


def normalize(text: Column) -> Column:
    """Without space, tab and line ends; lower case."""
    return F.lower(F.regexp_replace(text, r"[ \t\n\r]", ""))


def grading(text: Column) -> Column:
    """Trimmed, lower, without blanks, half width, without common punctuation."""
    x = F.regexp_replace(F.lower(F.trim(text)), r"[ \n\t]", "")
    return F.regexp_replace(F.regexp_replace(F.translate(x, FULL_WIDTH, HALF_WIDTH), GRADING_MARKS, " "), r"(?U)\s+", "")


def compact(text: Column) -> Column:
    """One form for punctuation that fonts vary, no middle dots, no white space, lower case."""
    return F.lower(F.regexp_replace(F.translate(text, FOLD_FROM, FOLD_TO), SPACES, ""))


def scope_key(text: Column) -> Column:
    """compact() without title marks, brackets and separators."""
    return F.translate(compact(text), SCOPE_MARKS, "")


def section_path(path: Column) -> Column:
    parts = F.transform(F.split(path, "/"), lambda x: F.regexp_replace(F.lower(x), SPACES, ""))
    return F.array_join(F.filter(parts, lambda x: x != ""), "/")


def section_scope(parts: Column) -> Column:
    """A section path as one comparable scope: answer-book labels and numbered topic prefixes stripped, headings that
    only name a question type dropped, repeats of the part before dropped, joined by /."""
    from scholia.functions.tables import BOOK_LABELS, TYPE_HEADINGS, TYPE_HEADINGS_EXACT

    def one(x: Column) -> Column:
        v = compact(x)
        for label in BOOK_LABELS:
            v = F.regexp_replace(v, "^" + label, "")
        v = F.regexp_replace(v, "^[·:：/-]+", "")
        return F.regexp_replace(v, TOPIC_PREFIX, "$1")

    kept = F.filter(F.transform(parts, one), lambda v: (v != "") & ~v.rlike("|".join(TYPE_HEADINGS)) & ~v.isin(TYPE_HEADINGS_EXACT))
    return F.array_join(F.aggregate(kept, F.array().cast("array<string>"), lambda acc, v: F.when(F.try_element_at(acc, F.lit(-1)).eqNullSafe(v), acc).otherwise(F.concat(acc, F.array(v)))), "/")


def name_key(text: Column) -> Column:
    """Without white space; case stays."""
    return F.regexp_replace(text, SPACES, "")


def fragment(text: Column) -> Column:
    """Lower, without blanks and eleven punctuation marks."""
    return F.translate(F.lower(text), " \t\r\n，。；：！？,.!?", "")


def loose(text: Column) -> Column:
    """Without white space, punctuation and symbols; then half width, lower."""
    return F.lower(F.translate(F.regexp_replace(text, r"(?U)[\p{P}\p{S}\s]", ""), FULL_WIDTH, HALF_WIDTH))


def answer_question(text: Column) -> Column:
    """loose() without leading section and number prefixes."""
    return loose(F.regexp_replace(F.trim(text), ANSWER_PREFIX, ""))


def stem_key(text: Column) -> Column:
    return F.regexp_replace(compact(text), "^[0-9]+[.)、]", "")


def evidence(text: Column) -> Column:
    """Letters and digits of compact()."""
    return F.regexp_replace(compact(text), r"[^\p{L}\p{Nd}]", "")


def is_question_start(line: Column) -> Column:
    return line.rlike(QUESTION_START)


def opens_question(stem: Column) -> Column:
    """Whether a stem begins with a mark that only a new question has."""
    return F.trim(stem).rlike(NEW_QUESTION_MARK)


def read_identity(written: Column) -> Column:
    """struct(path, role, set_no, kind, number) of "json path|role|set|type|number"; null fields where it isn't one."""
    part = lambda i: F.regexp_extract(written, r"^(\[.*\])\|([^|]*)\|(\d+)\|([^|]*)\|(\d+)$", i)
    return F.struct(
        F.from_json(part(1), "array<string>").alias("path"), F.nullif(part(2), F.lit("")).alias("role"), part(3).try_cast("int").alias("set_no"), F.nullif(part(4), F.lit("")).alias("kind"), part(5).try_cast("long").alias("number")
    )


def question_number(line: Column) -> Column:
    """The number of a line that opens with "N." or "N、"; 0 otherwise."""
    digits = F.regexp_extract(line, QUESTION_START, 1)
    return F.coalesce(F.when(digits != "", digits).try_cast("int"), F.lit(0))


def printed_markers(text: Column) -> Column:
    """Numbers of one to three digits that open a line, in order: with a mark and a blank after them, a mark and a title, or a bracket."""
    return F.filter(F.transform(F.regexp_extract_all(text, F.lit(PRINTED_MARKER), F.lit(1)), lambda x: x.cast("int")), lambda n: n > 0)


def canonical_type(raw: Column) -> Column:
    """Known aliases to five question types; anything else stays as folded."""
    v = F.regexp_replace(F.replace(F.lower(F.trim(raw)), F.lit("-"), F.lit("_")), "[ 、]", "")
    known = F.create_map(*(F.lit(x) for kv in TYPE_ALIASES.items() for x in kv))
    return F.coalesce(known[v], v)


def answer_glyph(value: Column, question_type: Column) -> Column:
    """Signs and words for true and false, in true_false questions, to one pair of words."""
    v = F.trim(value)
    return F.when(
        question_type == "true_false",
        F.when(F.lower(v).isin("√", "✓", "✔", "对", "t", "v", "true", "正确"), "正确").when(F.lower(v).isin("×", "✕", "✗", "x", "f", "错", "false", "错误"), "错误").otherwise(v),
    ).otherwise(v)


def rubric_letters(value: Column) -> Column:
    """The A-F letters of a value that holds nothing else (six bytes at most); null for other text."""
    c = F.upper(F.translate(value, " \t、,，/\\+&", ""))
    return F.when(c.rlike("^[A-F]{1,6}$"), F.filter(F.split(c, ""), lambda x: x != ""))


def warns(warnings: Column, words: list[str]) -> Column:
    return F.exists(warnings, lambda w: w.rlike("|".join(words)))


def starts_mid(stem: Column, warnings: Column) -> Column:
    """Whether a stem opens midway: a warning says so, or it begins with a separator or a sub-question's number."""
    return warns(warnings, START_WARNINGS) | F.trim(stem).rlike(MID_START)


def ends_mid(stem: Column, warnings: Column) -> Column:
    """Whether a stem ends midway: a warning says so, or no closing mark stands at its end (colons and semicolons close nothing)."""
    return warns(warnings, END_WARNINGS) | ((F.trim(stem) != "") & ~F.trim(stem).rlike(r"[。！？!?】）)\]》」』]$"))


def overlap(left: Column, right: Column, most: int = 80) -> Column:
    """Longest n from 2 to `most` such that left's last n characters and right's first n are one fragment; 0 if none."""
    a, b = F.trim(left), F.trim(right)
    top = F.least(F.lit(most), F.char_length(a), F.char_length(b))
    fits = F.filter(F.when(top >= 2, F.sequence(F.lit(2), top)).otherwise(F.array().cast("array<int>")), lambda n: fragment(F.right(a, n)) == fragment(F.left(b, n)))
    return F.coalesce(F.array_max(fits), F.lit(0))


def merge_fragments(left: Column, right: Column) -> Column:
    """Two pieces of one text: an end contained in the other side is dropped, an overlap is kept once, else both joined."""
    a, b = F.trim(left), F.trim(right)
    na, nb = fragment(a), fragment(b)
    n = overlap(a, b)
    return (
        F.when(a == "", b).when(b == "", a)
        .when((F.char_length(nb) >= 8) & F.endswith(na, nb), a)
        .when((F.char_length(na) >= 8) & F.startswith(nb, na), b)
        .when(n > 0, F.concat(a, F.substr(b, n + 1)))
        .otherwise(F.concat(a, b))
    )


def capital(letter: Column) -> Column:
    """One letter as one capital letter; upper() makes two of some, as SS of ß."""
    return F.when(F.contains(F.lit(ONE_CAPITAL_FROM), letter), F.translate(letter, ONE_CAPITAL_FROM, ONE_CAPITAL_TO)).otherwise(F.upper(letter))


def let(value: Column, f: Callable[[Column], Column]) -> Column:
    """f of a value that is computed once a row; written into a lambda as it is, it would be computed again for each element."""
    return F.get(F.transform(F.array(value), lambda x: f(x)), F.lit(0))


def grams(text: Column, n: int) -> Column:
    """All n-grams in order, from an array of the characters, so that a long text costs no more than its length."""
    every = lambda chars: F.transform(F.sequence(F.lit(1), F.size(chars) - n + 1), lambda i: F.array_join(F.slice(chars, i, n), ""))
    return F.when(F.char_length(text) >= n, let(F.split(text, ""), every)).otherwise(F.array().cast("array<string>"))


def gram_hashes(text: Column, least: int, most: int) -> Column:
    """Hashes of all n-grams from `least` to `most` characters, repeats included, each made of the shorter gram before it."""

    def longer(rungs: Column, n: Column) -> Column:
        ones, last = rungs[0], F.element_at(rungs, -1)
        m = F.greatest(F.size(ones) - n + 1, F.lit(0))
        return F.concat(rungs, F.array(F.zip_with(F.slice(last, F.lit(1), m), F.slice(ones, n, m), lambda x, y: F.xxhash64(x, y))))

    ones = F.when(F.char_length(text) > 0, F.transform(F.split(text, ""), lambda c: F.xxhash64(c))).otherwise(F.array().cast("array<bigint>"))
    rungs = F.aggregate(F.sequence(F.lit(2), F.lit(most)), F.array(ones), longer)
    return F.flatten(F.slice(rungs, least, most - least + 1))


def common_beginning(left: Column, right: Column) -> Column:
    """Length of the longest beginning that two texts share."""
    short = F.least(F.char_length(left), F.char_length(right))
    first = lambda v: F.array_min(F.filter(F.sequence(F.lit(1), v["n"]), lambda i: F.element_at(v["a"], i) != F.element_at(v["b"], i)))
    differs = let(F.struct(F.split(left, "").alias("a"), F.split(right, "").alias("b"), short.alias("n")), first)
    return F.when(short == 0, 0).otherwise(F.coalesce(differs - 1, short))


def shared_grams(left: Column, right: Column, least: int = 2, most: int = 4) -> Column:
    """How many of right's n-grams, repeats included, are n-grams of left."""

    def of(n: int) -> Column:
        return let(F.array_distinct(grams(left, n)), lambda own: F.size(F.filter(grams(right, n), lambda g: F.array_contains(own, g))))

    return sum((of(n) for n in range(least + 1, most + 1)), of(least))


def telling_gram(gram: Column, n: int) -> Column:
    """Whether a gram of n characters may count as evidence: no digits, brackets or generic words."""
    plain = ~gram.rlike(r"[0-9.、:：()（）]") & ~gram.rlike("|".join(GENERIC_WORDS))
    return plain & ~gram.rlike("|".join(GENERIC_SHORT)) if n <= 3 else plain


def evidence_score(stem: Column, text: Column) -> Column:
    """Sum of n squared over the distinct n-grams (6 to 3) of a stem that a text holds, generic ones left out."""

    def of(v: Column, n: int) -> Column:
        return F.size(F.filter(F.array_distinct(grams(v["s"], n)), lambda g: telling_gram(g, n) & F.contains(v["t"], g))) * (n * n)

    return let(F.struct(evidence(stem).alias("s"), evidence(text).alias("t")), lambda v: of(v, 3) + of(v, 4) + of(v, 5) + of(v, 6))


def mask_key(key: Column) -> Column:
    """First and last four characters of a long key; a short one vanishes."""
    return F.when(F.char_length(key) > 8, F.concat(F.left(key, F.lit(4)), F.lit("****"), F.right(key, F.lit(4)))).otherwise(F.lit("****"))


def safe_name(name: Column) -> Column:
    """A file name without path parts and unusual characters."""
    return F.regexp_replace(F.regexp_replace(name, r"^.*[/\\]", ""), r"[^\p{L}\p{Nd}._-]", "_")


def join_options(options: Column) -> Column:
    return F.array_join(F.transform(options, lambda o: F.concat(o["key"], F.lit(". "), o["content"])), " | ")


def hash16(text: Column) -> Column:
    """First 16 bytes of SHA-256, hex."""
    return F.substring(F.sha2(text, 256), 1, 32)


def contains_folded(text: Column, keyword: Column) -> Column:
    """Substring test that folds ASCII case only; % and _ of the keyword stay wildcards."""
    upper, lower = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
    pattern = F.concat(F.lit("%"), F.replace(F.translate(keyword, upper, lower), F.lit("\\"), F.lit("\\\\")), F.lit("%"))
    return F.call_function("like", F.translate(text, upper, lower), pattern)

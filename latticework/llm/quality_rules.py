"""Quality rules that clean line by line first and then look at what is left of a document.

Each line is held against three rules. Lines that fail are removed; a document that loses more than a share of its
words is rejected. Everything is a column expression on the row: no shuffle, whatever the documents look like.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce
from operator import add, or_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from latticework.llm.common import WORD, text_or_empty, words_of

SYMBOLS, WHITE = "#*$%&|<>", " \t\n\x0b\f\r"
#: Punctuation: a word with one of the symbols or with doubled ! or ? is noisy; a line fails from this share on.
NOISY_WORD, NOISY_PERCENT = r"[#*$%&<>]|[!?][!?]", 30
#: Navigation: link separators that stand alone or end a line; a line fails from one separator per so many words on.
SEPARATOR, WORDS_PER_SEPARATOR = r"(?:^|[\x20\x09-\x0D])(?:\||>|»|•|·)(?:$|[\x20\x09-\x0D])", 5
#: Boilerplate: phrases of notices and banners, in a line of so many words at most.
BOILERPLATE = r"(?i)all rights reserved|cookie policy|privacy policy|terms of (?:use|service)|accept (?:all )?cookies|subscribe to our newsletter|click here|licensed under|share on (?:facebook|twitter)|skip to (?:main )?content|^copyright |^©"
BOILERPLATE_WORDS = 30
#: A document is rejected if it loses more than this share of its words.
LOST_PERCENT = 50
LEAST_WORDS, REPEAT_PERCENT = 50, 50


#: What a line must hold for its words to be looked at, and lower-case starts of notices that a text must hold for its lines to be.
SUSPICIOUS = ("#", "*", "$", "%", "&", "<", ">", "!!", "!?", "?!", "??", "|", "»", "•", "·")
NOTICES = (
    "all rights reserved", "cookie policy", "privacy policy", "terms of use", "terms of service", "accept cookies", "accept all cookies", "subscribe to our newsletter",
    "click here", "licensed under", "share on facebook", "share on twitter", "skip to content", "skip to main content", "copyright ", "©",
)
#: Bits of a window's place beside its hash.
PLACE_BITS = 24


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body of value, with value computed once however often and in whatever lambda body names it."""
    return F.element_at(F.transform(F.array(value), body), 1)


def _replaced(text: Column, characters: str, by: str) -> Column:
    for c in characters:
        text = F.replace(text, F.lit(c), F.lit(by))
    return text


def _count_of(text: Column, characters: str) -> Column:
    """How often ASCII characters occur: bytes that go with them."""
    return reduce(add, [F.octet_length(text) - F.octet_length(F.replace(text, F.lit(c), F.lit(""))) for c in characters])


def _holds(text: Column, parts: tuple[str, ...]) -> Column:
    return reduce(or_, [text.contains(p) for p in parts])


def split_words(text: Column) -> Column:
    """The words of a text: what white space leaves. The same words as a search for WORD, without a regular expression."""
    return F.array_remove(F.split(_replaced(text, WHITE[1:], " "), " ", -1), "")


def line_fails(line: Column, with_notices: Column) -> Column:
    """Whether a line breaks a rule; notices are looked for where with_notices is true."""
    notice = with_notices & line.rlike(BOILERPLATE)

    def judged(words: Column) -> Column:
        noisy = F.size(F.filter(words, lambda w: w.rlike(NOISY_WORD)))
        separators = F.size(F.filter(words, lambda w: w.isin("|", ">", "»", "•", "·")))
        return (
            (100 * noisy >= NOISY_PERCENT * F.size(words))
            | ((separators > 1) & (WORDS_PER_SEPARATOR * separators >= F.size(words)))
            | (notice & (F.size(words) <= BOILERPLATE_WORDS))
        )

    # A line that holds none of these has no noisy word, no separator and no notice.
    return F.when(_holds(line, SUSPICIOUS) | notice, let(split_words(line), lambda w: (F.size(w) > 0) & judged(w))).otherwise(False)


def repeated_words(words: Column) -> Column:
    """Words that stand in a window of three words found twice or more, windows that overlap counted once."""

    def windows(w: Column) -> Column:
        at = F.sequence(F.lit(0), F.size(w) - 3)
        return F.transform(at, lambda i: F.xxhash64(F.get(w, i), F.get(w, i + 1), F.get(w, i + 2)))

    def candidates(w: Column, h: Column) -> Column:
        """Places of windows that share the upper bits of their hash with another, found by sorting numbers only."""
        upper = lambda x: F.shiftright(x, PLACE_BITS)
        packed = F.sort_array(F.transform(h, lambda x, i: F.shiftleft(upper(x), PLACE_BITS).bitwiseOR(i.cast("long"))))
        same = lambda x, y: F.coalesce(upper(x) == upper(y), F.lit(False))
        shared = lambda s: F.filter(s, lambda x, k: same(x, F.get(s, k - 1)) | same(x, F.get(s, k + 1)))
        places = let(packed, lambda s: F.transform(shared(s), lambda x: x.bitwiseAND(F.lit((1 << PLACE_BITS) - 1)).cast("int")))
        return F.when(F.size(w) < 1 << PLACE_BITS, places).otherwise(F.sequence(F.lit(0), F.size(w) - 3))

    def sorted_windows(w: Column, at: Column) -> Column:
        text = lambda i: F.concat_ws(" ", F.get(w, i), F.get(w, i + 1), F.get(w, i + 2))
        return F.sort_array(F.transform(at, lambda i: F.struct(text(i).alias("t"), i.alias("i"))))

    def found_again(s: Column) -> Column:
        same = lambda x, y: F.coalesce(x["t"] == y["t"], F.lit(False))
        return F.filter(s, lambda x, k: same(x, F.get(s, k - 1)) | same(x, F.get(s, k + 1)))

    def covered(again: Column) -> Column:
        return F.size(F.array_distinct(F.flatten(F.transform(again, lambda x: F.array(x["i"], x["i"] + 1, x["i"] + 2)))))

    # Most texts repeat no window; equal windows have equal hashes, so distinct hashes settle those without sorting.
    counted = lambda w, h: F.when(F.size(F.array_distinct(h)) == F.size(h), 0).otherwise(let(let(sorted_windows(w, candidates(w, h)), found_again), covered))
    return F.when(F.size(words) < 4, 0).otherwise(let(words, lambda w: let(windows(w), lambda h: counted(w, h))))


def quality(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """(id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, n_lost_words, base_failed, kept) for each row.

    A null or empty text has no words, so the base rule fails it. Each row is judged alone: ties, repeated rows and
    other columns change nothing, and an empty table gives no rows.
    """
    # Words stand in a column of their own, so that they are split once.
    text, words = F.col("text"), F.col("words")
    split = docs.select(F.col(f"`{id_column}`").alias("id"), text_or_empty(f"`{text_column}`").alias("text"), split_words(text_or_empty(f"`{text_column}`")).alias("words"))
    lines = F.filter(F.split(text, "\n", -1), lambda x: F.btrim(x, F.lit(WHITE)) != "")
    facts = split.select(
        F.col("id").alias(id_column),
        F.size(words).cast("long").alias("n_words"),
        (F.length(text) - _count_of(text, WHITE)).cast("long").alias("word_chars"),
        _count_of(text, SYMBOLS).cast("long").alias("n_symbols"),
        let(lines, lambda x: F.size(x) - F.size(F.array_distinct(x))).cast("long").alias("n_dup_lines"),
        repeated_words(words).cast("long").alias("n_repeat_words"),
        lost_words(text).alias("n_lost_words"),
    )
    failed = (F.col("n_words") < LEAST_WORDS) | (100 * F.col("n_repeat_words") > REPEAT_PERCENT * F.col("n_words"))
    return facts.select("*", failed.alias("base_failed"), (~failed & (100 * F.col("n_lost_words") <= LOST_PERCENT * F.col("n_words"))).alias("kept"))


def suspicious(text: Column) -> tuple[Column, Column]:
    """Whether a text may hold a line that fails, and whether one of its lines may be a notice."""
    notices = _holds(F.lower(text), NOTICES)
    return _holds(text, SUSPICIOUS) | notices, notices


def lost_words(text: Column) -> Column:
    """Words of the lines that fail."""
    some, notices = suspicious(text)
    lost = lambda n: F.aggregate(F.filter(F.split(text, "\n", -1), lambda x: line_fails(x, n)), F.lit(0).cast("long"), lambda n, x: n + F.size(split_words(x)))
    return F.when(some, let(notices, lost)).otherwise(F.lit(0).cast("long"))


def cleaned_text(text: Column) -> Column:
    """The text without the lines that fail."""
    some, notices = suspicious(text)
    return F.when(some, let(notices, lambda n: F.array_join(F.filter(F.split(text, "\n", -1), lambda x: ~line_fails(x, n)), "\n"))).otherwise(text)


def passing(docs: DataFrame, text_column: str = "text") -> DataFrame:
    """The rows of docs whose text passes, with the lines that fail removed from it; other columns as they are.

    Nulls, empty texts and repeated rows count as in quality(); other columns may have any names. An empty table gives no rows.
    """
    text = text_or_empty(f"`{text_column}`")

    def kept(words: Column) -> Column:
        n = F.size(words)
        # Lines that fail have words, so the words that are missing are theirs.
        left = lambda clean: F.when(clean == text, n).otherwise(F.size(split_words(clean)))
        clean = let(cleaned_text(text), lambda clean: F.when(100 * (n - left(clean)) <= LOST_PERCENT * n, F.array(clean)))
        return F.when(n >= LEAST_WORDS, F.when(100 * repeated_words(words) <= REPEAT_PERCENT * n, clean))

    # One expression does each step once: exploding its array of one or no text drops what is rejected.
    return docs.select(*[F.explode(let(split_words(text), kept)).alias(c) if c == text_column else F.col(f"`{c}`") for c in docs.columns])

"""Quality rules: a table of thresholds compiled into one projection over a text, without user functions.

Every measure is a built-in expression over the text, bound once by a one-element transform where it is used several times.
A rule holds a measure, what it is divided by, and bounds in thousandths, so verdicts are comparisons of whole numbers.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
BLANKS, MARKS = " \t\n\x0b\x0c\r", ".,;:!?\"()"
#: Frequent function words of English, French, German and Spanish.
STOP_WORDS = tuple(
    "the of and to in that is for with it as was on be at by this have are or from not "
    "le la les de des et un une est que qui dans pour il en du "
    "der die das und ist den von zu mit sich nicht ein eine "
    "el los las y se por con una no".split())


@dataclass(frozen=True)
class Rule:
    """``least`` and ``most`` thousandths of ``per`` (1 if none) that ``measure`` may have; no bound if None."""

    name: str
    measure: str
    per: str | None = None
    least: int | None = None
    most: int | None = None

    def holds(self, value: Callable[[str], Column]) -> Column:
        share, whole = value(self.measure) * 1000, value(self.per) if self.per else F.lit(1)
        bounds = [share >= self.least * whole] * (self.least is not None) + [share <= self.most * whole] * (self.most is not None)
        return bounds[0] & bounds[-1]


#: What fails any text: too few words, or too many in windows that come again.
BASE = (
    Rule("too_few_words", "n_words", None, 10_000),
    Rule("repeated_windows", "n_repeat_words", "n_words", None, 200),
)
RULES = (
    Rule("length", "n_words", None, None, 100_000_000),
    Rule("word_length", "word_chars", "n_words", 2_500, 12_000),
    Rule("symbols", "n_symbols", "n_words", None, 100),
    Rule("capitals", "n_capitals", "n_letters", None, 500),
    Rule("words_with_letters", "n_letter_words", "n_words", 550),
    Rule("stop_words", "n_stop_words", "n_words", 40),
    Rule("repeated_lines", "n_dup_lines", "n_lines", None, 400),
    Rule("bullet_lines", "n_bullet_lines", "n_lines", None, 900),
    Rule("ellipsis_lines", "n_ellipsis_lines", "n_lines", None, 300),
)


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is computed once."""
    return F.transform(F.array(value), body)[0]


def without(text: Column, symbols: str) -> Column:
    return F.length(F.translate(text, symbols, ""))


def repeat_words(words: Column, width: int = 5) -> Column:
    """Words inside windows of ``width`` words that stand at two places or more.

    A text whose windows all have hashes of their own has none. Of others the windows are sorted by a second hash behind the
    first, 96 bits together, so a window comes again if a neighbour has its hashes; their starts, in order, each add the
    words up to the next start, ``width`` at most.
    """
    def window(w: Column, word: Column, i: Column) -> list[Column]:
        return [word, *[F.get(w, i + j) for j in range(1, width)]]

    def starts(w: Column, hashes: Column) -> Column:
        def again(hashed: Column) -> Column:
            def same(x: Column, other: Column) -> Column:
                return F.coalesce((x["a"] == other["a"]) & (x["b"] == other["b"]), F.lit(False))

            return F.filter(hashed, lambda x, i: same(x, F.get(hashed, i + 1)) | ((i > 0) & same(x, F.get(hashed, i - 1))))

        keyed = F.transform(hashes, lambda h, i: F.struct(h.alias("a"), F.hash(*window(w, F.get(w, i), i)).alias("b"), i.alias("at")))
        return F.sort_array(F.transform(let(F.sort_array(keyed), again), lambda x: x["at"]))

    def covered(at: Column) -> Column:
        each = F.transform(at, lambda x, i: F.least(F.lit(width), F.coalesce(F.get(at, i + 1) - x, F.lit(width))))
        return F.aggregate(each, F.lit(0).cast("bigint"), lambda a, x: a + x)

    def counted(w: Column) -> Column:
        hashes = F.slice(F.transform(w, lambda word, i: F.xxhash64(*window(w, word, i))), 1, F.greatest(F.size(w) - (width - 1), F.lit(0)))
        return let(hashes, lambda h: F.when(F.size(F.array_distinct(h)) == F.size(h), F.lit(0).cast("bigint")).otherwise(
            let(starts(w, h), covered)))

    return let(words, counted)


def measures(text: Column) -> dict[str, Column]:
    """Whole numbers of a text by name; the text must not be null."""
    def several(array: Column, parts: dict[str, Callable[[Column], Column]]) -> Column:
        return let(array, lambda x: F.struct(*[f(x).cast("bigint").alias(n) for n, f in parts.items()]))

    def lines_of(x: Column) -> Column:
        return F.filter(x, lambda line: line.rlike(r"[^\x20\x09-\x0D]"))

    plain = F.split(F.translate(text, UPPER + MARKS, LOWER), r"[\x20\x09-\x0D]+")
    words = several(F.regexp_extract_all(text, F.lit(r"[^\x20\x09-\x0D]+"), F.lit(0)), {
        "n_words": F.size,
        "n_letter_words": lambda w: F.size(F.filter(w, lambda x: x.rlike(r"\p{L}"))),
        "n_repeat_words": repeat_words,
    })
    lines = several(lines_of(F.split(text, "\n")), {
        "n_lines": F.size,
        "n_dup_lines": lambda x: F.size(x) - F.size(F.array_distinct(x)),
        "n_bullet_lines": lambda x: F.size(F.filter(x, lambda line: line.rlike(r"^[\x20\x09-\x0D]*[-*•]"))),
        "n_ellipsis_lines": lambda x: F.size(F.filter(x, lambda line: line.rlike(r"(…|[.]{3})[\x20\x09-\x0D]*\z"))),
    })
    return {
        "words": words, "lines": lines,
        "word_chars": without(text, BLANKS).cast("bigint"),
        "n_symbols": (F.length(text) - without(text, "#*$%&|<>")).cast("bigint"),
        "n_capitals": (F.length(text) - without(text, UPPER)).cast("bigint"),
        "n_letters": (F.length(text) - without(text, UPPER + LOWER)).cast("bigint"),
        "n_stop_words": F.size(F.filter(plain, lambda x: x.isin(*STOP_WORDS))).cast("bigint"),
    }


def verdicts(text: Column, rules: tuple[Rule, ...] = RULES, base: tuple[Rule, ...] = BASE) -> Column:
    """All measures, ``base_failed``, ``failed`` (names of the rules that do not hold, in table order) and ``kept``, as one struct."""
    def judged(x: Column) -> Column:
        def value(name: str) -> Column:
            for part in ("words", "lines"):
                if name in PARTS[part]:
                    return x[part][name]
            return x[name]

        def failed(table: tuple[Rule, ...]) -> Column:
            return F.filter(F.array(F.lit(None).cast("string"), *[F.when(~r.holds(value), F.lit(r.name)) for r in table]), F.isnotnull)

        return let(F.struct(failed(base).alias("base"), failed(rules).alias("more")), lambda f: F.struct(
            *[value(n).alias(n) for n in COUNTS], (F.size(f["base"]) > 0).alias("base_failed"),
            F.concat(f["base"], f["more"]).alias("failed"), (F.size(f["base"]) + F.size(f["more"]) == 0).alias("kept")))

    return let(F.struct(*[c.alias(n) for n, c in measures(F.coalesce(text, F.lit(""))).items()]), judged)


PARTS = {"words": ("n_words", "n_letter_words", "n_repeat_words"),
         "lines": ("n_lines", "n_dup_lines", "n_bullet_lines", "n_ellipsis_lines")}
COUNTS = (*PARTS["words"], *PARTS["lines"], "word_chars", "n_symbols", "n_capitals", "n_letters", "n_stop_words")


def apply_rules(docs: DataFrame, rules: tuple[Rule, ...] = RULES, base: tuple[Rule, ...] = BASE) -> DataFrame:
    """One row per document: doc_id, the measures, base_failed, failed and kept.

    A null text is an empty one and fails the base. Rows are judged one by one, so repeated rows and repeated or missing
    doc_ids are rows of their own, and no row moves between tasks. A very long text takes some 300 bytes a word while its
    windows are sorted. Other columns are not read, whatever their names; an empty table gives no rows.
    """
    return docs.select("doc_id", verdicts(F.col("text"), rules, base).alias("of")).select("doc_id", "of.*")


def keep_good(docs: DataFrame, rules: tuple[Rule, ...] = RULES, base: tuple[Rule, ...] = BASE) -> DataFrame:
    """The rows of the table whose text breaks no rule, with all their columns."""
    return docs.where(verdicts(F.col("text"), rules, base)["kept"])

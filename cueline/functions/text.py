"""Text columns. White space and word rules follow Unicode, as ``(?U)`` classes do."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

SPACE = r"(?U)\s+"
#: Blocks of four scripts that metadata may not use; they are contiguous.
DISALLOWED_SCRIPTS = r"[஀-ൿ]"


def col(x: Column | str) -> Column:
    return F.col(x) if isinstance(x, str) else x


def once(value: Column, use) -> Column:
    """``use`` of a value that is worked out once, however often ``use`` refers to it."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def fixed(x: Column | str, places: int) -> Column:
    """A number with so many decimal places, halves to even."""
    return F.call_function("format_number", col(x), F.lit("0." + "0" * places))


def strip(x: Column | str) -> Column:
    return F.regexp_replace(F.regexp_replace(col(x), r"(?U)\A\s+", ""), r"(?U)\s+\z", "")


def is_blank(x: Column | str) -> Column:
    """Whether nothing is left of a text when it is stripped; ends at the first other character."""
    return ~col(x).rlike(r"(?U)\S")


def words(x: Column | str) -> Column:
    """Non-empty words; an empty or blank text has none."""
    return F.filter(F.split(col(x), SPACE), lambda w: w != "")


def clean(x: Column | str) -> Column:
    """White space collapsed to single spaces, ends stripped."""
    return F.array_join(words(x), " ")


def word_count(x: Column | str) -> Column:
    return F.coalesce(F.size(words(x)), F.lit(0))


def comparison_key(x: Column | str) -> Column:
    """Lower-case letters and digits only."""
    return F.regexp_replace(F.lower(col(x)), "[^a-z0-9]+", "")


def hashtag(x: Column | str, default: str = "#Gaming") -> Column:
    kept = F.regexp_replace(col(x), "[^a-zA-Z0-9]+", "")
    return F.when(kept == "", F.lit(default)).otherwise(F.concat(F.lit("#"), kept))


def cut_title(x: Column | str, most: int = 100) -> Column:
    """Clean title, cut on a word's edge to ``most`` characters with an ellipsis."""

    def cut(whole: Column) -> Column:
        # of what has a space before its last word, that word goes
        short = F.regexp_replace(F.regexp_replace(F.substring(whole, 1, most - 3), r"(?U)\s+\z", ""), " [^ ]*$", "")
        return F.when(F.length(whole) <= most, whole).otherwise(F.concat(short, F.lit("...")))

    return once(clean(x), cut)


def ordered_distinct(x: Column | str) -> Column:
    """First spelling of each value of an array, whatever its case, in order."""
    none = F.array().cast("array<string>")
    init = F.struct(none.alias("low"), none.alias("kept"))

    def step(acc: Column, v: Column) -> Column:
        low = F.lower(v)
        both = F.struct(F.array_append(acc["low"], low).alias("low"), F.array_append(acc["kept"], v).alias("kept"))
        return F.when(F.array_contains(acc["low"], low), acc).otherwise(both)

    # every value is worked out once; arrays are short
    return F.aggregate(col(x), init, step, lambda acc: acc["kept"])


def safe_name(x: Column | str, default: str = "video") -> Column:
    """Name for a run or folder: Unicode letters and digits, others as single underscores."""
    kept = F.regexp_replace(strip(x), r"[^\p{L}\p{N}]+", "_")
    kept = F.regexp_replace(kept, "^_+|_+$", "")
    return F.when(F.coalesce(kept, F.lit("")) == "", F.lit(default)).otherwise(kept)


def slug(x: Column | str, default: str = "untitled") -> Column:
    """Lower-case ASCII slug."""
    kept = F.regexp_replace(F.regexp_replace(F.lower(col(x)), "[^a-z0-9]+", "_"), "^_+|_+$", "")
    return F.when(F.coalesce(kept, F.lit("")) == "", F.lit(default)).otherwise(kept)


def title_case(x: Column | str) -> Column:
    """Words capitalised; upper-case words of up to 5 letters stay."""
    one = lambda w: F.when((F.upper(w) == w) & (F.lower(w) != w) & (F.length(w) <= 5), w).otherwise(F.concat(F.upper(F.substring(w, 1, 1)), F.lower(F.substr(w, F.lit(2)))))
    return F.array_join(F.transform(words(x), one), " ")


def has_disallowed_script(x: Column | str) -> Column:
    return col(x).rlike(DISALLOWED_SCRIPTS)


def caption_lines(x: Column | str, default: str) -> Column:
    """Words of a caption on one to three lines: 1-2 words one line, 3 and 4 two, 5 and more three."""

    def lines(w: Column) -> Column:
        n = F.size(w)
        join = lambda a, b: F.array_join(F.slice(w, a, b), " ")
        first = F.when(n == 3, 2).when(n == 4, 2).when(n == 5, 2).otherwise(F.ceil(n * 0.4)).cast("int")
        second = F.when(n == 5, 4).otherwise(F.ceil(n * 0.75)).cast("int")
        return (
            F.when(F.coalesce(n, F.lit(0)) == 0, F.array(F.lit(default)))
            .when(n <= 2, F.array(join(F.lit(1), n)))
            .when(n <= 4, F.array(join(F.lit(1), first), join(first + 1, n - first)))
            .otherwise(F.array(join(F.lit(1), first), join(first + 1, second - first), join(second + 1, n - second)))
        )

    return once(words(x), lines)

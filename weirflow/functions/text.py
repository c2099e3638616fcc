"""Column functions of the per-line verbs. Each takes and gives Columns, stays in the JVM and passes nulls on."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

NUMBER = r"^[+-]?(?:(?:[0-9]+\.?[0-9]*|\.[0-9]+)(?:[eE][+-]?[0-9]+)?|(?i:inf(?:inity)?|nan))$"


def as_column(x: Column | str) -> Column:
    return F.col(x) if isinstance(x, str) else x


def once(x: Column | str, use) -> Column:
    """``use`` of a value that is computed one time, however often ``use`` names it: edits of edits stay small plans."""
    return F.get(F.transform(F.array(as_column(x)), use), F.lit(0))


def utrim(x: Column | str) -> Column:
    """Trim all Unicode white space; ``trim`` takes blanks only."""
    return F.regexp_replace(as_column(x), r"(?U)^\s+|\s+$", "")


def num(x: Column | str) -> Column:
    """The line as a double, null where it isn't a number; NaN counts as none."""
    t = utrim(x)
    value = F.when(t.rlike(NUMBER), F.expr("try_cast(1 AS double)") * t.try_cast("double"))
    return F.when(~F.isnan(value), value)


def words(x: Column | str) -> Column:
    """White-space separated words."""
    return F.filter(F.split(as_column(x), r"(?U)\s+"), lambda w: w != "")


def field_at(x: Column | str, n: int) -> Column:
    """The n-th word, from 1; 0 is the whole line; empty where there is none."""
    return as_column(x) if n == 0 else F.coalesce(F.get(words(x), F.lit(n - 1)), F.lit(""))


def fields_at(x: Column | str, *numbers: int) -> Column:
    return F.concat_ws(" ", *[field_at(x, n) for n in numbers])


def cut(x: Column | str, delimiter: str, n: int = 1) -> Column:
    """The n-th part between literal delimiters; 0 behaves as 1; empty where there is none."""
    return F.coalesce(F.get(F.split(as_column(x), _quote(delimiter), -1), F.lit(max(n, 1) - 1)), F.lit(""))


def _quote(literal: str) -> str:
    return "".join("\\" + c if not c.isalnum() and not c.isspace() and c != "_" and ord(c) < 128 else c for c in literal)


def split_on(x: Column | str, delimiter: str) -> Column:
    return F.split(as_column(x), _quote(delimiter), -1)


def extract(x: Column | str, pattern: str, group: int = 0) -> Column:
    """The first match's group, null without a match."""
    return F.when(as_column(x).rlike(pattern), F.regexp_extract(as_column(x), pattern, group))


def substr(x: Column | str, a: int, b: int) -> Column:
    """Characters a to b, from 0, end exclusive."""
    return F.substring(as_column(x), a + 1, max(b - a, 0))


def title(x: Column | str) -> Column:
    """Each word capitalised, single blanks between."""
    return F.array_join(F.transform(words(x), lambda w: F.concat(F.upper(F.substring(w, 1, 1)), F.lower(F.substring(w, 2, 1 << 30)))), " ")


def pad(x: Column | str, n: int) -> Column:
    """Filled with blanks on the right to n characters; never cut."""
    x = as_column(x)
    return F.when(F.length(x) < n, F.rpad(x, min(n, 65535), " ")).otherwise(x)


def lpad(x: Column | str, n: int) -> Column:
    x = as_column(x)
    return F.when(F.length(x) < n, F.lpad(x, min(n, 65535), " ")).otherwise(x)


def basename(x: Column | str) -> Column:
    return F.substring_index(F.regexp_replace(as_column(x), "/+$", ""), "/", -1)


def dirname(x: Column | str) -> Column:
    """Before the last slash; ``/x`` gives ``/`` and ``x`` gives ``.``."""
    bare = F.regexp_replace(as_column(x), "/+$", "")
    return F.when(bare.rlike("^/[^/]*$"), "/").when(bare.contains("/"), F.regexp_extract(bare, "(?s)^(.*)/[^/]*$", 1)).otherwise(".")


def commafy(x: Column | str) -> Column:
    """A comma after every third digit of the integer part."""
    x = as_column(x)
    whole = F.regexp_replace(F.regexp_extract(x, r"^([+-]?\d+)", 1), r"(?<=\d)(?=(?:\d{3})+$)", ",")
    return F.when(x.rlike(r"^[+-]?\d+(?:\.\d+)?$"), F.concat(whole, F.regexp_extract(x, r"^[+-]?\d+(.*)$", 1))).otherwise(x)


def plain_number(x: Column) -> Column:
    """A double as text without a trailing ``.0``; whole numbers under 1e15 without an exponent."""
    return F.when((x == F.floor(x)) & (F.abs(x) < 1e15), x.cast("bigint").cast("string")).otherwise(x.cast("string"))


def fmt_num(x: Column | str) -> Column:
    """A double as text: its shortest digits, in full unless they would need more than 15 zeros or three leading ones.

    ``1e+16``, ``15000000000000000``, ``0.0001``, ``1e-05``; infinities are the largest doubles, NaN is ``null``, -0 is 0.
    The digits are the JVM's, which for a few doubles (the smallest among them) are one more than needed. Most numbers are
    written as the JVM writes them; only others have their digits and exponent taken apart.
    """
    x = as_column(x)
    size = F.abs(x)
    return (
        F.when(F.isnan(x), "null")
        .when((size < 1e15) & (x == F.floor(x)), x.cast("bigint").cast("string"))
        .when((size >= 1e-3) & (size < 1e7), x.cast("string"))
        .when(size == float("inf"), F.when(x < 0, "-1.7976931348623157e+308").otherwise("1.7976931348623157e+308"))
        .when(x.isNotNull(), F.concat(F.when(x < 0, "-").otherwise(""), once(size.cast("string"), _digits_moved)))
    )


def _digits_moved(shown: Column) -> Column:
    """A positive double's text, as the JVM writes it, in the form of ``fmt_num``."""
    digits = F.regexp_replace(F.regexp_replace(F.regexp_replace(F.regexp_extract(shown, r"^([0-9.]+)", 1), r"\.", ""), "^0+", ""), "0+$", "")
    zeros = F.length(F.regexp_extract(shown, r"^0\.(0*)", 1))
    whole = F.length(F.regexp_extract(shown, r"^([0-9]+)", 1))
    power = F.coalesce(F.regexp_extract(shown, r"E(-?[0-9]+)$", 1).try_cast("int"), F.lit(0))
    point = F.when(shown.startswith("0."), -zeros).otherwise(whole) + power  # 0.d1d2... times ten to this

    def text(digits: Column, point: Column) -> Column:
        n, exponent = F.length(digits), point - 1
        tail = F.when(n > 1, F.concat(F.lit("."), F.substring(digits, 2, 400))).otherwise("")
        scientific = F.concat(F.substring(digits, 1, 1), tail, F.lit("e"), F.when(exponent < 0, "-").otherwise("+"), F.lpad(F.abs(exponent).cast("string"), F.greatest(F.length(F.abs(exponent).cast("string")), F.lit(2)), F.lit("0")))
        plain = (
            F.when(point <= 0, F.concat(F.lit("0."), F.repeat(F.lit("0"), -point), digits))
            .when(point >= n, F.concat(digits, F.repeat(F.lit("0"), point - n)))
            .otherwise(F.concat(F.substring(digits, F.lit(1), point), F.lit("."), F.substring(digits, point + 1, F.lit(400))))
        )
        return F.when((point <= -4) | (point > n + 15), scientific).otherwise(plain)

    return once(digits, lambda d: once(point, lambda p: text(d, p)))


def human_bytes(x: Column | str) -> Column:
    """1024-based size with one decimal, a zero decimal left out; text that is no number passes."""
    n = num(x)
    step = F.least(F.floor(F.log2(F.greatest(F.abs(n), F.lit(1.0))) / 10), F.lit(5)).cast("int")
    scaled = F.round(n / F.pow(F.lit(1024.0), step), 1)
    unit = F.element_at(F.array(*[F.lit(u) for u in ("B", "KB", "MB", "GB", "TB", "PB")]), step + 1)
    return F.when(n.isNull(), as_column(x)).otherwise(F.concat_ws(" ", plain_number(scaled), unit))


def human_duration(x: Column | str) -> Column:
    """Seconds as the two largest units of days, hours, minutes and seconds that aren't zero."""
    n = F.floor(num(x)).cast("bigint")
    parts = F.array(
        F.struct(F.expr("int(0)").alias("k"), F.floor(n / 86400).alias("v"), F.lit("d").alias("u")),
        F.struct(F.lit(1).alias("k"), F.floor(n % 86400 / 3600).alias("v"), F.lit("h").alias("u")),
        F.struct(F.lit(2).alias("k"), F.floor(n % 3600 / 60).alias("v"), F.lit("m").alias("u")),
        F.struct(F.lit(3).alias("k"), (n % 60).alias("v"), F.lit("s").alias("u")),
    )
    shown = F.slice(F.filter(parts, lambda p: p["v"] > 0), 1, 2)
    text = F.array_join(F.transform(shown, lambda p: F.concat(p["v"].cast("string"), p["u"])), " ")
    return F.when(n.isNull(), as_column(x)).when(n == 0, "0s").otherwise(text)


def b64(x: Column | str) -> Column:
    return F.regexp_replace(F.base64(as_column(x).cast("binary")), "[\r\n]", "")


def b64d(x: Column | str) -> Column:
    """Decoded where the line is base64 of UTF-8, else as it is."""
    x = as_column(x)
    return F.coalesce(F.when(x.rlike("^(?:[A-Za-z0-9+/]{4})*(?:[A-Za-z0-9+/]{2}==|[A-Za-z0-9+/]{3}=)?$"), F.try_validate_utf8(F.unbase64(x).cast("string"))), x)


def hexed(x: Column | str) -> Column:
    return F.lower(F.hex(as_column(x).cast("binary")))


def unhexed(x: Column | str) -> Column:
    x = as_column(x)
    return F.coalesce(F.when(x.rlike("^(?:[0-9A-Fa-f]{2})*$"), F.try_validate_utf8(F.unhex(x).cast("string"))), x)


def urlenc(x: Column | str) -> Column:
    """Every byte but ASCII letters and digits as %XX."""
    pairs = F.regexp_extract_all(F.hex(as_column(x).cast("binary")), F.lit("(..)"), F.lit(1))
    plain = lambda h: F.unhex(h).cast("string").rlike("^[0-9A-Za-z]$") & (h < "80")
    return F.array_join(F.transform(pairs, lambda h: F.when(plain(h), F.unhex(h).cast("string")).otherwise(F.concat(F.lit("%"), h))), "")


def urldec(x: Column | str) -> Column:
    """Each %XX decoded; a plus sign and a percent sign without two digits stay; a line that would not be UTF-8 passes as it is."""
    x = as_column(x)
    stray = F.regexp_replace(F.replace(x, F.lit("+"), F.lit("%2B")), "%(?![0-9A-Fa-f]{2})", "%25")
    decoded = F.try_url_decode(stray)
    # the decoder puts U+FFFD for bytes that are no UTF-8
    broken = decoded.contains("\ufffd") & ~x.contains("\ufffd") & ~F.lower(x).contains("%ef%bf%bd")
    return F.when(~broken, decoded).otherwise(x)


def clamp(x: Column, low: float, high: float) -> Column:
    if not low <= high:
        raise ValueError("clamp needs low <= high")
    return F.least(F.greatest(x, F.lit(float(low))), F.lit(float(high)))


def divide(a: Column, b: Column) -> Column:
    """IEEE division: a zero divisor gives an infinity or NaN, and never an error."""
    by_zero = F.when(a == 0, F.lit(float("nan"))).otherwise(F.signum(a) * F.lit(float("inf")))
    return F.when(b == 0, by_zero).otherwise(F.try_divide(a, b))


def matches_query(x: Column | str, query: str) -> Column:
    """Case-insensitive substring of the whole line; an empty query takes all."""
    return F.lower(as_column(x)).contains(query.lower()) if query else F.lit(True)


def in_selection(x: Column, selection: str) -> Column:
    """One of a comma-separated selection; an empty one takes all."""
    chosen = [s.strip() for s in selection.split(",") if s.strip()]
    return x.isin(chosen) if chosen else F.lit(True)

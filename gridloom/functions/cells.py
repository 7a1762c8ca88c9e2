"""Column expressions over table cells: all built-in functions, no Python at run time.

Cells are strings; a missing cell is the empty string, and a null one counts as that.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .patterns import checked

# Patterns that decide results.
EMAIL = r"[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}"
URL = r"(?i)https?://\S+"
DATE = r"(?i)(?:\d{1,4}[-/.]\d{1,2}[-/.]\d{1,4}|\d{1,2}[\s-]+[A-Za-z]{3,9}[\s,-]+\d{2,4}|[A-Za-z]{3,9}[\s,]+\d{1,2},?\s+\d{2,4})"
NUMBER = r"-?\d+([.,]\d+)?"
PHONE = r"\+?[\d\s().-]{7,15}"
CURRENCY = r"(?i)(?:\(?[₹$€£]\s?-?\d[\d,]*(\.\d+)?\)?|\(?-?\d[\d,]*(\.\d+)?\)?\s?(INR|USD|EUR|GBP|Rs\.?))"
BOOLEAN = r"(?i)(yes|no|y|n|true|false|t|f)"
KEPT_PUNCTUATION = ".,;:!?()'\"-_/@%&$#*+"
PRINTABLE_PUNCTUATION = ".,;:!?()'\"-_/@%&"
TRUE_WORDS = ("yes", "y", "true", "t", "1")
FALSE_WORDS = ("no", "n", "false", "f", "0")
BOOLEAN_SPELLINGS = {"YES_NO": ("Yes", "No"), "TRUE_FALSE": ("True", "False"), "ONE_ZERO": ("1", "0")}
MONTHS = ("jan", "feb", "mar", "apr", "may", "jun", "jul", "aug", "sep", "oct", "nov", "dec")
LONG_MONTHS = ("january", "february", "march", "april", "may", "june", "july", "august", "september", "october", "november", "december")
# End of fixed values.

TYPES = {"EMAIL": EMAIL, "URL": URL, "DATE": DATE, "BOOLEAN": BOOLEAN, "CURRENCY": CURRENCY, "NUMBER": NUMBER, "PHONE": PHONE}


def col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def full(c: Column | str, pattern: str) -> Column:
    """Whether the whole of a string matches."""
    flags = "(?i)" if pattern.startswith("(?i)") else ""
    return col(c).rlike(rf"{flags}\A(?:{pattern.removeprefix('(?i)')})\z")


def literal(text: str) -> str:
    """A pattern for the characters of a class."""
    return "".join("\\" + x if not x.isalnum() else x for x in text)


def ws_trim(c: Column | str) -> Column:
    """Without the white space of all kinds around it (``trim`` takes spaces only)."""
    return F.regexp_replace(col(c), r"\A[\s\p{Z}]+|[\s\p{Z}]+\z", "")


def blank(c: Column | str) -> Column:
    return ~F.coalesce(col(c), F.lit("")).rlike(r"[^\s\p{Z}]")


def collapse(c: Column | str) -> Column:
    return F.regexp_replace(col(c), r"\s+", " ")


def strip_unwanted(c: Column | str) -> Column:
    """Letters, digits, white space and everyday punctuation alone."""
    return F.regexp_replace(col(c), rf"[^\p{{L}}\p{{Nd}}\s{literal(KEPT_PUNCTUATION)}]", "")


def title(c: Column | str) -> Column:
    """Words parted by single spaces: the first character in upper case, the others in lower."""
    return F.array_join(F.transform(F.split(col(c), " ", -1), lambda w: F.concat(F.upper(F.substring(w, 1, 1)), F.lower(F.substring(w, 2, 1 << 30)))), " ")


def change_case(c: Column | str, mode: str) -> Column:
    return {"LOWER": F.lower, "UPPER": F.upper, "TITLE": title, "NONE": lambda x: x}[mode](col(c))


def replace_all(c: Column | str, find: str, to: str, regex: bool = False, ignore_case: bool = False) -> Column:
    """Find and replace; ``to`` is taken as it is for a literal ``find``, with group references for a pattern. Patterns that may run away are refused."""
    if find == "":
        return col(c)
    if regex:
        checked(find, ignore_case)
    pattern = find if regex else rf"\Q{find}\E" if "\\E" not in find else literal(find)
    out = to if regex else to.replace("\\", "\\\\").replace("$", "\\$")
    return F.regexp_replace(col(c), F.lit(("(?i)" if ignore_case else "") + pattern), F.lit(out))


def normal_email(c: Column | str) -> Column:
    """Lower case without white space around it; null if that is no address."""
    low = F.lower(ws_trim(c))
    return F.when(full(low, EMAIL), low)


def normal_phone(c: Column | str) -> Column:
    """Ten digits, after the prefixes 1, 91 and 091; null for everything else."""
    digits = F.regexp_replace(col(c), r"\D", "")
    n = F.length(digits)
    cut = lambda k: F.substring(digits, k + 1, 10)
    return F.when(n == 10, digits).when((n == 11) & digits.startswith("1"), cut(1)).when((n == 12) & digits.startswith("91"), cut(2)).when((n == 13) & digits.startswith("091"), cut(3))


def _date(year: Column, month: Column, day: Column) -> Column:
    return F.concat_ws("-", *[F.lpad(x.cast("string"), n, "0") for x, n in ((year, 4), (month, 2), (day, 2))])


def _real_date(text: Column) -> Column:
    """The text if it is a day of the calendar from the year 1000 on, else null; computed once."""
    return F.get(F.filter(F.array(text), lambda t: (t >= "1000") & F.try_to_date(t, "yyyy-MM-dd").isNotNull()), 0)


def normal_date(c: Column | str, month_first: bool = False) -> Column:
    """ISO date of a date spelled with numbers or an English month, null if it is none.

    Of two numbers up to 12 the first is the day, or the month with ``month_first``. Years of up to two digits are 2000 to 2030 and 1931 to 1999.
    """
    v = ws_trim(c)
    number = lambda pattern, group: F.regexp_extract(v, pattern, group).try_cast("int")
    names = F.create_map(*[F.lit(x) for i in range(12) for x in (MONTHS[i], i + 1)], *[F.lit(x) for i in range(12) if LONG_MONTHS[i] not in MONTHS for x in (LONG_MONTHS[i], i + 1)], F.lit("sept"), F.lit(9))
    month = lambda pattern, group: F.try_element_at(names, F.lower(F.regexp_extract(v, pattern, group)))

    def year(pattern, group):
        n = number(pattern, group)
        short = F.length(F.regexp_extract(v, pattern, group)) <= 2
        return F.when(short, F.when(n <= 30, n + 2000).otherwise(n + 1900)).otherwise(n)

    iso = r"\A(\d{4})-(\d{1,2})-(\d{1,2})\z"
    dmy = r"\A(\d{1,2})[\s-]+([A-Za-z]{3,9})[\s,-]+(\d{2,4})\z"
    mdy = r"\A([A-Za-z]{3,9})[\s,]+(\d{1,2}),?\s+(\d{2,4})\z"
    num = r"\A(\d{1,4})[/.\-](\d{1,2})[/.\-](\d{1,4})\z"
    a, b = number(num, 1), number(num, 2)
    b_is_month = F.when((a > 12) & (b <= 12), True).when((b > 12) & (a <= 12), False).otherwise(not month_first)
    numeric = F.when(F.length(F.regexp_extract(v, num, 1)) == 4, _date(a, b, number(num, 3))).when(b_is_month, _date(year(num, 3), b, a)).otherwise(_date(year(num, 3), a, b))
    return _real_date(
        F.when(v.rlike(iso), _date(number(iso, 1), number(iso, 2), number(iso, 3)))
        .when(v.rlike(dmy) & month(dmy, 2).isNotNull(), _date(year(dmy, 3), month(dmy, 2), number(dmy, 1)))
        .when(v.rlike(mdy) & month(mdy, 1).isNotNull(), _date(year(mdy, 3), month(mdy, 1), number(mdy, 2)))
        .when(v.rlike(num), numeric)
    )


def plain_number(x: Column) -> Column:
    """A double as text: whole values without decimals, others in plain notation."""
    whole = (x == F.floor(x)) & (F.abs(x) < 9.2e18)
    return F.when(whole, x.cast("decimal(38,0)").cast("string")).otherwise(x.cast("string"))


def normal_currency(c: Column | str) -> Column:
    """An amount of money as a plain number; parentheses are a minus, other text is dropped. Null without a number."""
    v = ws_trim(c)
    negative = v.startswith("(") & v.endswith(")")
    n = F.regexp_replace(F.regexp_replace(v, r"(?i)[₹$€£,\s]|INR|USD|EUR|GBP|Rs\.?", ""), r"[^0-9.\-]", "").try_cast("double")
    return plain_number(F.when(negative, -F.abs(n)).otherwise(n))


def normal_boolean(c: Column | str, spelling: str = "YES_NO") -> Column:
    yes, no = BOOLEAN_SPELLINGS[spelling]
    v = F.lower(ws_trim(c))
    return F.when(v.isin(*TRUE_WORDS), yes).when(v.isin(*FALSE_WORDS), no)


def parse_number(c: Column | str) -> Column:
    """A number with currency marks, commas and accounting parentheses allowed, and nothing else; null otherwise."""
    # A plain number needs no other patterns, and what can be cast as it stands has no marks that they would take out.
    # Texts that begin like none, empty ones above all, are not cast: a cast that fails costs more than all patterns.
    text = col(c).cast("string")
    plain = F.when(text.rlike(r"\A[\x00-\x20]*[+-]?[.\dIiNn]"), text.try_cast("double"))
    v = ws_trim(c)
    negative = (F.length(v) > 1) & v.startswith("(") & v.endswith(")")
    inner = F.when(negative, F.substring(v, F.lit(2), F.length(v) - 2)).otherwise(v)
    n = F.regexp_replace(F.regexp_replace(inner, r"(?i)\b(INR|USD|EUR|GBP|Rs\.?)\s*", ""), r"[₹$€£,\s]", "")
    n = F.when(n != "", n).try_cast("double")
    return F.coalesce(plain, F.when(text != "", F.when(negative, -F.abs(n)).otherwise(n)))


def format_number(x: Column, decimals: int = 2) -> Column:
    """Fixed-point text, halves rounded up; empty for what is no finite number."""
    scale = float(10**decimals)
    rounded = F.floor(x * scale + 0.5).cast("double") / scale
    odd = F.isnan(x) | (F.abs(x) == float("inf"))
    return F.when(x.isNull(), None).when(odd, "").otherwise(F.format_string(f"%.{decimals}f", rounded))


def calculate(a: Column, op: str, b: Column) -> Column:
    """ADD, SUBTRACT, MULTIPLY or DIVIDE; null for a division by zero."""
    return {"ADD": a + b, "SUBTRACT": a - b, "MULTIPLY": a * b, "DIVIDE": F.when(b != 0, F.try_divide(a, b))}[op]


def nearly(a: Column, b: Column) -> Column:
    """Equal as amounts of money: within 0.02 or a hundredth of the larger."""
    return F.abs(a - b) <= F.greatest(F.lit(0.02), F.greatest(F.abs(a), F.abs(b)) * 0.01)


def similarity(a: Column, b: Column) -> Column:
    longest = F.greatest(F.length(a), F.length(b))
    return F.when(a == b, 1.0).otherwise(1.0 - F.levenshtein(a, b) / longest)


def guarded(c: Column | str) -> Column:
    """Marked as text if a spreadsheet might take it for a formula; numbers and phone numbers stay."""
    v = col(c)
    t = ws_trim(v)
    harmless = t.rlike(r"\A[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?\z") | t.rlike(r"\A\+?[\d\s().-]{5,}\z")
    return F.when((F.length(v) > 1) & v.rlike(r"\A[=+\-@\t\r]") & ~harmless, F.concat(F.lit("'"), v)).otherwise(v)


def dangerous_formula(c: Column | str) -> Column:
    f = ws_trim(c)
    return (F.contains(f, F.lit("|")) & F.contains(f, F.lit("!"))) | f.rlike(r"(?i)\b(WEBSERVICE|FILTERXML|RTD|CALL|REGISTER|EXEC)\s*\(")


def masked(c: Column | str) -> Column:
    """The whole text with e-mail names and long runs of digits hidden but for the first letter and the last four digits."""
    # A name is tried where its letters begin or the last match ended, and its letters are not given back: texts of any length take time in proportion.
    mail = r"(?:\G|(?<![A-Za-z0-9._%+-]))([A-Za-z0-9._%+-])[A-Za-z0-9._%+-]*+@([A-Za-z0-9.-]+\.[A-Za-z]{2,})"
    v = F.when(F.contains(col(c), F.lit("@")), F.regexp_replace(col(c), mail, "$1***@$2")).otherwise(col(c))
    # Where a word ends is told by ASCII letters, as digits are: Java's \b takes an é for a letter, its \w does not.
    return F.regexp_replace(v, r"(?<!\w)(?:\d[ -]?){8,15}(\d)[ -]?(\d)[ -]?(\d)[ -]?(\d)[ -]?(?:(?<=\w)(?!\w)|(?<!\w)(?=\w))", "••••$1$2$3$4")


def masked_preview(c: Column | str, longest: int = 300) -> Column:
    """The beginning of a text, cut before it is masked: what the history keeps."""
    return masked(F.substring(col(c), 1, longest))


def text_quality(c: Column | str, expected: int = 20) -> Column:
    """0 to 100 by length, printable characters, word lengths and blank lines."""
    v = col(c)
    words = F.filter(F.split(v, r"\s+"), lambda w: w != "")
    printable = F.length(F.regexp_replace(v, rf"[^\p{{L}}\p{{Nd}}\s{literal(PRINTABLE_PUNCTUATION)}]", ""))
    mean = F.aggregate(words, F.lit(0), lambda a, w: a + F.length(w)) / F.size(words)
    lines = F.split(v, r"\r\n|\n|\r", -1)
    empty = F.size(F.filter(lines, lambda x: ws_trim(x) == ""))
    score = F.least(F.lit(1.0), F.length(ws_trim(v)) / float(expected)) * 30 + printable / F.length(v) * 30
    score = score + F.when(mean.between(2.0, 12.0), 20.0).otherwise(8.0) + (1.0 - empty / F.size(lines)) * 20
    return F.when(blank(v), 0).otherwise(F.floor(F.greatest(F.lit(0.0), F.least(F.lit(100.0), score))).cast("int"))


def quality_label(score: Column) -> Column:
    return F.when(score >= 85, "Excellent").when(score >= 65, "Good").when(score >= 40, "Fair").otherwise("Poor")


def content_key(c: Column | str) -> Column:
    """The digest by which equal inputs are known."""
    return F.sha2(col(c), 256)


def word_count(c: Column | str) -> Column:
    return F.regexp_count(col(c), F.lit(r"\S+"))


def char_count(c: Column | str) -> Column:
    return F.length(col(c))


def duration_text(ms: Column) -> Column:
    return F.when(ms < 1000, F.concat(ms.cast("string"), F.lit("ms"))).otherwise(F.format_string("%.1fs", ms / 1000.0))


def size_text(size: Column) -> Column:
    """Bytes as B, KB or MB of a thousand each."""
    return F.when(size >= 1_000_000, F.format_string("%.1f MB", size / 1e6)).when(size >= 1000, F.format_string("%.1f KB", size / 1e3)).otherwise(F.concat(size.cast("string"), F.lit(" B")))


def safe_extension(c: Column | str) -> Column:
    """``.ext`` for up to eight letters and digits, else ``.tmp``."""
    bare = F.regexp_replace(col(c), r"\A\.", "")
    return F.when(bare.rlike(r"\A[\p{L}\p{Nd}]{1,8}\z"), F.concat(F.lit("."), bare)).otherwise(".tmp")


def output_name(c: Column | str) -> Column:
    """A name that stays in its folder: no path, no reserved or control characters, 120 characters at most with its extension."""
    bare = F.regexp_replace(F.regexp_replace(col(c), r"\A(?s:.*)[/\\]", ""), r"[\x00-\x1F\x7F<>:\"|?*]", "_")
    bare = F.regexp_replace(ws_trim(bare), r"\A\.+|\.+\z", "")
    bare = F.when(blank(bare), "output").otherwise(bare)
    extension = F.regexp_extract(bare, r"\A.+(\.[^.]{0,9})\z", 1)
    return F.when(F.length(bare) > 120, F.concat(F.substring(bare, F.lit(1), 120 - F.length(extension)), extension)).otherwise(bare)


def safe_sheet_name(c: Column | str) -> Column:
    return F.substring(F.regexp_replace(col(c), r"[\\/?*\[\]:]", "_"), 1, 31)


def cell_column(ref: Column | str) -> Column:
    """Number of the column in an address such as C7, from 0 on."""
    letters = F.upper(F.regexp_extract(col(ref), r"\A\$?([A-Za-z]{1,3})", 1))
    return F.aggregate(F.filter(F.split(letters, ""), lambda x: x != ""), F.lit(0), lambda a, x: a * 26 + F.ascii(x) - 64) - 1


def cell_row(ref: Column | str) -> Column:
    return F.regexp_extract(col(ref), r"(\d{1,7})\z", 1).try_cast("int") - 1

"""Text expressions (T1-T3, T5, T8, T11, T24, T26, T28, L6, C10). Each takes and returns a Column."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .staged import let

#: White space as the OCR rules mean it: ASCII, no-break space and byte order mark.
SPACE = "[ \\t\\n\\x0B\\f\\r\\u00a0\\ufeff]"
#: An ASCII word boundary; Java's own treats accented letters as word characters.
EDGE = "(?:(?<=[A-Za-z0-9_])(?![A-Za-z0-9_])|(?<![A-Za-z0-9_])(?=[A-Za-z0-9_]))"


def words_pattern(words: str) -> str:
    """Case-insensitive pattern for one of the alternatives, which begin and end in letters, as a whole word."""
    return f"(?i){first_letters(words)}(?<![A-Za-z0-9_])(?:{words})(?![A-Za-z0-9_])"


def first_letters(words: str) -> str:
    """A look-ahead for the first letters of alternatives, so that other places are left at once; empty where one can
    begin with something else."""
    heads, depth, start = set(), 0, 0
    for i, c in enumerate(words + "|"):
        depth += (c == "(") - (c == ")")
        if c == "|" and depth == 0:
            heads.add(words[start:i])
            start = i + 1
    plain = all(h[:1].isascii() and h[:1].isalpha() and h[1:2] not in ("?", "*", "{") for h in heads) and "[" not in words and "\\(" not in words and "\\)" not in words
    return f"(?=[{''.join(sorted({x for h in heads for x in (h[0].lower(), h[0].upper())}))}])" if plain else ""


def normalize_ocr(text: Column) -> Column:
    """Line ends to LF, no-break to plain spaces, no zero-width spaces, trimmed."""
    plain = text
    for old, new in (("\r\n", "\n"), ("\r", "\n"), ("\u00a0", " "), ("\u200b", "")):
        plain = F.replace(plain, F.lit(old), F.lit(new))
    return F.regexp_replace(plain, f"^{SPACE}+|{SPACE}+$", "")


def collapse(text: Column) -> Column:
    """Runs of white space to one space, trimmed."""
    return F.trim(F.regexp_replace(text, f"{SPACE}+", " "))


def collapsed_lines(text: Column) -> Column:
    """The lines of a text that :func:`normalize_ocr` gave, each as :func:`collapse` gives it, in two passes over the text."""
    in_line = SPACE.replace("\\n", "")
    plain = F.regexp_replace(text, f"{in_line}+", " ")
    return F.split(F.regexp_replace(plain, " ?\n ?", "\n"), "\n")


def alpha_heavy(text: Column) -> Column:
    """In tokens of 3 letters or more and no more digits than letters, digits that OCR mistakes become letters."""
    parts = F.regexp_extract_all(text, F.lit("([A-Za-z0-9]+|[^A-Za-z0-9]+)"))

    def fixed(part: Column) -> Column:
        letters, digits = F.length(F.regexp_replace(part, "[^A-Za-z]", "")), F.length(F.regexp_replace(part, "[^0-9]", ""))
        return F.when((letters >= 3) & (digits > 0) & (digits <= letters), F.translate(part, "014568", "OIASGB")).otherwise(part)

    return F.array_join(F.transform(parts, fixed), "")


def edit_distance(a: Column, b: Column, most: int) -> Column:
    """T5: edit distance, -1 above ``most``."""
    return F.levenshtein(a, b, most)


# Spellings of units and what they stand for.
UNITS = {
    "NO": "NOS", "NOS": "NOS", "PC": "PCS", "PCS": "PCS", "PIECE": "PCS", "PIECES": "PCS", "UNIT": "UNITS", "UNITS": "UNITS",
    "HR": "HRS", "HRS": "HRS", "HOUR": "HRS", "HOURS": "HRS", "SET": "SETS", "SETS": "SETS", "KW": "KW", "KWP": "KW", "KWH": "KWH",
}


def canonical_unit(value: Column) -> Column:
    """Canonical unit; other letters as they are, null without any."""
    compact = F.regexp_replace(F.upper(alpha_heavy(value)), "[^A-Z]", "")
    known = F.create_map(*[F.lit(x) for pair in UNITS.items() for x in pair])
    return F.when(compact != "", F.coalesce(F.try_element_at(known, compact), compact))


# Cue patterns of a line.
TOTAL = "grand\\s+total|invoice\\s+total|net\\s+amount|amount\\s+due|amount\\s+payable|amount\\s+chargeable|total"
SUBTOTAL = "subtotal|sub\\s+total|taxable"
TAX = "igst|cgst|sgst|gst|tax"
SOFT_TOTAL = "on account|balance due|amount chargeable|paid"
LINE_ITEM = "qty|quantity|rate|unit|per|hsn|disc|description|goods|service"
METADATA = "irn|ack|gstin|ifs|branch|bank|jurisdiction|phone|email|dispatch"


# Words that may stand before an amount.
CUE_WORDS = "grand|total|invoice|net|amount|due|payable|chargeable|on|account|balance|subtotal|taxable|igst|cgst|sgst|gst|tax|paid"


def total_cue(line: Column) -> Column:
    """An explicit total that is neither a subtotal nor a tax amount."""
    return line.rlike(words_pattern(TOTAL)) & ~line.rlike(words_pattern(SUBTOTAL)) & ~line.rlike(f"(?i)^Tax Amount{EDGE}")


def line_cues(line: Column) -> dict[str, Column]:
    """Cue flags of a line whose white space is collapsed."""
    total = total_cue(line)
    return {
        "total_cue": total,
        "subtotal_cue": line.rlike(words_pattern(SUBTOTAL)),
        "tax_cue": line.rlike(words_pattern(TAX)) & ~total,
        "soft_total_cue": line.rlike(words_pattern(SOFT_TOTAL)),
        "line_item_cue": line.rlike(words_pattern(LINE_ITEM)) | line.rlike("^[0-9]+\\s+") | line.rlike(f"(?i)(?:^|\\s)(?:nos|pcs|kw|hrs|sets){EDGE}"),
        "metadata_cue": line.rlike(words_pattern(METADATA)),
    }


def fnv1a(text: Column) -> Column:
    """FNV-1a, 32 bits, over the code points of an ASCII text."""
    mask = F.lit(4294967295)
    start = F.lit(2166136261).cast("long")
    chars = F.filter(F.split(text, ""), lambda c: c != "")
    return F.aggregate(chars, start, lambda h, c: (h.bitwiseXOR(F.ascii(c).cast("long")) * F.lit(16777619)).bitwiseAND(mask))


# Words that a context keeps.
CONTEXT_WORDS = (
    "grand|total|invoice|proforma|net|amount|due|payable|chargeable|on|account|balance|subtotal|sub|taxable|igst|cgst|sgst|gst|tax|paid|"
    "qty|quantity|unit|rate|hsn|disc|description|goods|service|round|off|tcs|kw|nos|pcs|bill|details|ship|buyer|seller"
)


def context_summary(text: Column) -> Column:
    """Cue tokens of a segment in order of first appearance, flags first."""
    low = F.lower(collapse(text))
    flag = lambda pattern, name: F.when(low.rlike(pattern), F.lit(name))
    flags = F.array_compact(F.array(
        flag("₹|rs\\.?", "currency"), flag("[0-9][0-9,]*\\.[0-9]{2}", "money"), flag(f"(?=[0-9]){EDGE}[0-9]+\\.[0-9]{{3}}{EDGE}", "qty_decimal"),
        flag(f"(?=d){EDGE}dr{EDGE}", "dr"), flag(f"(?=c){EDGE}cr{EDGE}", "cr"),
    ))
    tokens = F.array_distinct(F.concat(flags, F.regexp_extract_all(low, F.lit(f"{first_letters(CONTEXT_WORDS)}(?<![A-Za-z0-9_])({CONTEXT_WORDS})(?![A-Za-z0-9_])"))))
    return F.when(low == "", "none").when(F.size(tokens) > 0, F.array_join(tokens, " ")).otherwise("text_only")


def document_type(text: Column) -> Column:
    """Type by title, of a text or of its first eight lines joined."""
    return (
        F.when(text.rlike("(?i)PROFORMA INVOICE"), "PROFORMA INVOICE").when(text.rlike("(?i)TAX INVOICE"), "TAX INVOICE")
        .when(text.rlike(words_pattern("INVOICE")), "INVOICE").otherwise("RECEIPT")
    )


def currency(text: Column) -> Column:
    """INR where the text shows rupees, else USD."""
    return F.when(text.contains("₹") | text.rlike(words_pattern("INR|Rs")), "INR").otherwise("USD")


# Industry cues in order of priority.
INDUSTRIES = [
    ("stockist", "stockist|free qty|free quantity|scheme discount|scheme"),
    ("pharma", "mrp|batch no|expiry|tablet|capsule|syrup|pharma|drug"),
    ("medical", "serial no|implant|surgical|diagnostic|medical device"),
    ("trading", "transport|dispatch|vehicle no|lr no|lorry receipt|packing"),
]


def industry(text: Column) -> Column:
    """First industry with a cue, else generic."""
    found = F
    for name, cues in INDUSTRIES:
        found = found.when(text.rlike(words_pattern(cues)), name)
    return found.otherwise("generic")


def split_columns(line: Column) -> Column:
    """Parts of a line between two or more spaces."""
    return F.filter(F.transform(F.split(line, f"{SPACE}{{2,}}"), collapse), lambda x: x != "")


# Letters that OCR puts for digits.
LOOK_ALIKE = ("OoQDIil|SsB", "00001111558")


def numeric_like(text: Column) -> Column:
    """T4: look-alike letters become digits next to a digit, dot or comma; the left neighbour counts as replaced."""

    def replaced(plain: Column) -> Column:
        def step(out: Column, i: Column) -> Column:
            c = F.substring(plain, i, F.lit(1))
            digit = F.translate(c, *LOOK_ALIKE)
            near = F.substring(out, -1, 1).rlike("[0-9.,]") | F.substring(plain, i + 1, F.lit(1)).rlike("[0-9.,]")
            return F.concat(out, F.when((digit != c) & near, digit).otherwise(c))

        places = F.when(F.length(plain) > 0, F.sequence(F.lit(1), F.length(plain))).otherwise(F.array().cast("array<int>"))
        return F.aggregate(places, F.lit(""), step)

    return let(collapse(text), replaced)


def party_name(text: Column) -> Column:
    """Collapsed name with repaired company suffixes."""
    out = collapse(text)
    # Worn suffixes and what they stand for.
    for worn, right in (("L\\s+LP", "LLP"), ("PVT\\.?\\s+LID", "Pvt Ltd"), ("PRIVATE\\s+LID", "Private Ltd"), ("LID", "Ltd"), ("LTD", "Ltd"), ("LIMITED", "Limited")):
        out = F.regexp_replace(out, words_pattern(worn), right)
    return out


# Words of document titles, and words between them.
TITLE_WORDS = "ACK BILL CASH COPY CREDIT DEBIT DUPLICATE INVOICE NOTE ORIGINAL PROFORMA PURCHASE RECEIPT RETAIL SALES TAX TRIPLICATE VOUCHER".split()
TITLE_LINKS = "A AN FOR OF THE".split()


def document_title(text: Column) -> Column:
    """Whether one to four words are all words of titles."""
    words = F.filter(F.split(F.regexp_replace(F.upper(alpha_heavy(collapse(text))), "[^A-Z ]+", " "), "\\s+"), lambda w: (w != "") & ~w.isin(TITLE_LINKS))
    return let(words, lambda w: F.size(w).between(1, 4) & F.forall(w, lambda x: x.isin(TITLE_WORDS)))


def structured_noise(text: Column) -> Column:
    """Whether a text is a piece of a structured document: a bracket at its start or alone, or a quoted key."""
    plain = collapse(text)
    return plain.rlike("^[\\[{]") | plain.rlike("^[\\]}]$") | plain.rlike('^"[^"]+"\\s*:') | plain.rlike("^[A-Za-z_][A-Za-z0-9_ -]*\\s*:\\s*[{\\[]")

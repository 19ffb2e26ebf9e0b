"""Functions over DNA strings, Phred+33 qualities and tagged headers, all built from Spark's own functions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

BASES = "ACGTN"
COMPLEMENT = "TGCAN"

#: Header tags of corrected records, and those that the statistics count.
RECORD_TAGS = ("CR", "CY", "CB", "XQ", "XP", "XM", "UR", "UY")
STATS_TAGS = ("CR", "CB", "XM", "XP", "UR")


def _col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def chars(seq) -> Column:
    """The characters of a string; none for the empty one."""
    return F.filter(F.split(_col(seq), ""), lambda c: c != "")


def repeat_char(char: str, n) -> Column:
    return F.rpad(F.lit(""), F.greatest(_col(n).cast("int"), F.lit(0)), F.lit(char))


def reverse_complement(seq) -> Column:
    """A-T and C-G exchanged and the order reversed; N stays, as do other characters (see is_dna)."""
    return F.reverse(F.translate(_col(seq), BASES, COMPLEMENT))


def is_dna(seq) -> Column:
    """True if only A, C, G, T and N occur."""
    return F.translate(_col(seq), BASES, "") == ""


def hamming(a, b) -> Column:
    """Places where two strings of one length differ; null if their lengths differ."""
    a, b = _col(a), _col(b)
    differ = F.aggregate(F.zip_with(chars(a), chars(b), lambda x, y: (x != y).cast("int")), F.lit(0), lambda s, x: s + x)
    return F.when(F.length(a) == F.length(b), differ)


#: Bases that packed_bases() has room for, three bits each.
PACKED = 20
_FOLD = int("001" * PACKED, 2)


def packed_bases(seq) -> Column:
    """Three bits a base of ACGTN as a number; null if there are other characters, or over PACKED of them."""
    seq = _col(seq)
    return F.when(is_dna(seq) & (F.length(seq) <= PACKED), F.coalesce(F.conv(F.translate(seq, BASES, "01234"), 8, 10).cast("long"), F.lit(0)))


def packed_distance(x, y, a, b) -> Column:
    """hamming(a, b) for sequences of one length whose packed_bases() are x and y: by bits, or by character without them."""
    differ = _col(x).bitwiseXOR(_col(y))
    folded = differ.bitwiseOR(F.shiftright(differ, 1)).bitwiseOR(F.shiftright(differ, 2)).bitwiseAND(F.lit(_FOLD))
    return F.when(differ.isNull(), hamming(a, b)).otherwise(F.bit_count(folded))


def hamming_common(a, b) -> Column:
    """As hamming(), over the length that both have."""
    a, b = _col(a), _col(b)
    n = F.least(F.length(a), F.length(b))
    return hamming(F.substring(a, F.lit(1), n), F.substring(b, F.lit(1), n))


def encode_bits(seq) -> Column:
    """Two bits a base (A 0, C 1, G 2, T 3, any other 0) as a number; up to 31 bases."""
    digits = F.regexp_replace(F.translate(_col(seq), "ACGT", "0123"), "[^0-3]", "0")
    return F.when(F.length(digits) <= 31, F.coalesce(F.conv(digits, 4, 10).cast("long"), F.lit(0)))


def hamming_bits(a, b) -> Column:
    """Half the bits in which two encoded sequences differ: at most their distance, so a filter before hamming()."""
    return F.floor(F.bit_count(_col(a).bitwiseXOR(_col(b))) / 2).cast("int")


def kmer_of(number, k: int) -> Column:
    """The sequence of k bases that encode_bits() gives this number for."""
    return F.translate(F.lpad(F.conv(_col(number).cast("string"), 10, 4), k, "0"), "0123", "ACGT")


def encode_compact(seq) -> Column:
    """A digit a base: A 0, C 1, G 2, T 3, N 4, any other 0."""
    return F.regexp_replace(F.translate(_col(seq), BASES, "01234"), "[^0-4]", "0")


def mask_low_quality(seq, qual, threshold) -> Column:
    """Bases whose quality is under the threshold become N; over the length that both strings have."""
    seq, qual = _col(seq), _col(qual)
    n = F.least(F.length(seq), F.length(qual))
    low = f"\\x00-\\x{{{min(max(threshold + 32, 0), 0x10FFFF):x}}}"
    # by runs of high and low qualities: far fewer than bases
    runs = F.regexp_extract_all(F.substring(qual, F.lit(1), n), F.lit(f"[{low}]+|[^{low}]+"), F.lit(0))
    add = lambda done, run: F.concat(done, F.when(F.ascii(run) - 33 >= threshold, F.substring(seq, F.length(done) + 1, F.length(run))).otherwise(F.repeat(F.lit("N"), F.length(run))))
    return F.when(seq.isNotNull(), F.aggregate(runs, F.lit(""), add))


def phred_char(score) -> Column:
    return F.char(_col(score) + 33)


def update_length(comment, n) -> Column:
    """`length=` numbers of a header comment replaced."""
    return F.regexp_replace(_col(comment), F.lit(r"length=\d+"), F.concat(F.lit("length="), _col(n).cast("string")))


def strip_mate_suffix(comment) -> Column:
    return F.regexp_replace(_col(comment), "/[0-9]$", "")


def header_words(header) -> Column:
    """A header's words with one blank before and after each, as header_tag() reads them."""
    return F.concat(F.lit(" "), F.regexp_replace(F.trim(_col(header)), r"\s+", " "), F.lit(" "))


def header_tag(words, tag: str, strip_suffix: bool = True) -> Column:
    """Value of a header's last `TAG=value` word, the header as header_words(); null if it has none."""
    words, start = _col(words), f" {tag}="
    value = F.substring_index(F.substring_index(words, start, -1), " ", 1)
    return F.when(F.contains(words, F.lit(start)), F.regexp_replace(value, r"/\d+$", "") if strip_suffix else value)


def header_tags(header, tags=RECORD_TAGS, strip_suffix: bool = True) -> Column:
    """Map of the KEY=VALUE words of a header whose key is known; the value begins after the first `=`, the last wins.

    Where a few tags are wanted as columns, header_tag() finds them without a map.
    """
    words = header_words(header)
    found = F.array(*[F.struct(F.lit(t).alias("key"), header_tag(words, t, strip_suffix).alias("value")) for t in tags])
    return F.map_from_entries(F.filter(found, lambda e: e["value"].isNotNull()))


def sam_tag(fields, tag: str) -> Column:
    """Value of the first `TAG:Z:` among the fields from the twelfth on; null if there is none."""
    found = F.filter(F.slice(_col(fields), 12, 2**20), lambda f: F.startswith(f, F.lit(f"{tag}:Z:")))
    return F.substr(F.get(found, F.lit(0)), F.lit(6))


def header_barcode(description, index: int) -> Column:
    """The index-th (from 1) `+`-separated barcode of the first `:`-field that has a `+`; null if there is none."""
    field = F.get(F.filter(F.split(_col(description), ":"), lambda f: F.contains(f, F.lit("+"))), F.lit(0))
    return F.get(F.split(field, r"\+"), F.lit(index - 1))


def parse_range(text: str) -> tuple[int, int]:
    """1-based inclusive `a-b` as 0-based half-open."""
    a, _, b = text.partition("-")
    if not a.isdigit() or not b.isdigit():
        raise ValueError(f"not a range: {text!r}")
    return max(0, int(a) - 1), int(b)


def parse_file_range(text: str) -> tuple[int, int, int]:
    """`file:a-b`, all from 1, as (0-based file, 0-based start, end)."""
    file, _, rest = text.partition(":")
    if not file.isdigit() or int(file) < 1:
        raise ValueError(f"not a file and range: {text!r}")
    return (int(file) - 1, *parse_range(rest))

"""Queries over the driver's tables for each operator, and SQL that gives the same rows."""

from __future__ import annotations

import json
import re
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import sequence as S
from ..operators import counts as C
from ..operators import discovery as D
from ..operators import extraction as E
from ..operators import index as I
from ..operators import matching as M
from ..operators import peaks as P
from ..operators import records as R
from ..operators import windows as V
from .. import sources as Z
from ..sources.scratch import part_files, scratch, stored
from . import fixtures as X

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    """Register a query under its name, with its SQL if there is any."""

    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql is not None:
            SQL[f.__name__] = sql
        return f

    return add


BASE = "WITH " + X.BASE
REC = "WITH " + X.RECORDS
RC = "reverse(translate({}, 'ACGTN', 'TGCAN'))"

# ---- functions -------------------------------------------------------------------------------------------------


@query(f"{BASE} SELECT read_idx, {RC.format('seq')} AS rc FROM reads")
def reverse_complement(spark, sf_dir):
    return X.flat_reads(spark, sf_dir).select("read_idx", S.reverse_complement("seq").alias("rc"))


@query(f"{BASE} SELECT a.bc AS a, b.bc AS b, cast(hamming(a.bc, b.bc) AS int) AS n FROM wl a JOIN wl b ON a.id <= b.id")
def hamming_distance(spark, sf_dir):
    wl = X.whitelist(spark, sf_dir)
    pairs = wl.select(F.col("id").alias("i"), F.col("bc").alias("a")).join(F.broadcast(wl), F.col("i") <= F.col("id"))
    return pairs.select("a", F.col("bc").alias("b"), S.hamming("a", "bc").alias("n"))


_BITS = "cast(list_sum(list_transform(range(1, 9), lambda i: (strpos('ACGT', substr({0}, i, 1)) - 1) * cast(4 ** (8 - i) AS bigint))) AS bigint)"


@query(f"{BASE} SELECT bc, {_BITS.format('bc')} AS bits, translate(bc, 'ACGTN', '01234') AS compact, bc AS kmer FROM wl")
def bit_encode(spark, sf_dir):
    wl = X.whitelist(spark, sf_dir)
    return wl.select("bc", S.encode_bits("bc").alias("bits"), S.encode_compact("bc").alias("compact"), S.kmer_of(S.encode_bits("bc"), 8).alias("kmer"))


@query(f"{BASE}, e AS (SELECT id, bc, {_BITS.format('bc')} AS x FROM wl) SELECT a.bc AS a, b.bc AS b, cast(bit_count(xor(a.x, b.x)) // 2 AS int) AS n FROM e a JOIN e b ON a.id <= b.id")
def hamming_bits(spark, sf_dir):
    wl = X.whitelist(spark, sf_dir).withColumn("x", S.encode_bits("bc"))
    pairs = wl.select(F.col("id").alias("i"), F.col("bc").alias("a"), F.col("x").alias("y")).join(F.broadcast(wl), F.col("i") <= F.col("id"))
    return pairs.select("a", F.col("bc").alias("b"), S.hamming_bits("x", "y").alias("n"))


_MASK = "array_to_string(list_transform(range(1, length({0}) + 1), lambda i: CASE WHEN ascii(substr({1}, i, 1)) - 33 >= 25 THEN substr({0}, i, 1) ELSE 'N' END), '')"


@query(f"{BASE} SELECT read_idx, {_MASK.format('seq', 'qual')} AS masked FROM reads")
def quality_mask(spark, sf_dir):
    return X.flat_reads(spark, sf_dir).select("read_idx", S.mask_low_quality("seq", "qual", 25).alias("masked"))


@query(f"{BASE} SELECT read_idx, regexp_replace(comment, 'length=[0-9]+', concat('length=', cast(length(seq) AS varchar)), 'g') AS comment, regexp_replace(concat(read_name, '/1'), '/[0-9]$', '') AS name FROM reads")
def header_cleaning(spark, sf_dir):
    reads = X.flat_reads(spark, sf_dir)
    return reads.select("read_idx", S.update_length("comment", F.length("seq")).alias("comment"), S.strip_mate_suffix(F.concat("read_name", F.lit("/1"))).alias("name"))


@query(f"{BASE} SELECT read_idx, split_part(split_part(split_part(comment, ' ', 1), ':', 4), '+', 1) AS first, split_part(split_part(split_part(comment, ' ', 1), ':', 4), '+', 2) AS second, cast(NULL AS varchar) AS third FROM reads")
def header_barcodes(spark, sf_dir):
    word = F.substring_index("comment", " ", 1)
    return X.flat_reads(spark, sf_dir).select("read_idx", *[S.header_barcode(word, i + 1).alias(n) for i, n in enumerate(("first", "second", "third"))])


@query(f"{REC} SELECT line, CR, CB, XM, regexp_replace(XP, '/[0-9]+$', '') AS XP FROM rec")
def header_tags(spark, sf_dir):
    rec = X.records(spark, sf_dir)
    names = ("CR", "CB", "XM", "XP")
    header = F.concat_ws(" ", F.lit("@x"), *[F.concat(F.lit(f"{n}="), F.col(n)) for n in names], F.lit("ZZ=1=2 /1"))
    return rec.select("line", S.header_tags(header, names).alias("t")).select("line", *[F.col("t")[n].alias(n) for n in names])


# ---- windows and matching --------------------------------------------------------------------------------------


def windows_sql(start: int, size: int, jitter: int, seq: str = "seq", source: str = "reads", more: str = "") -> str:
    """Rows (read_idx, cand, pos): sliding windows, then windows clipped on the left and on the right."""
    columns = f"read_idx{more}"
    parts = [f"SELECT {columns}, substr({seq}, p, {size}) AS cand, cast(p AS int) AS pos FROM (SELECT *, unnest(range({max(1, start - jitter)}, least(cast(length({seq}) AS int) - {size} + 1, {start + jitter}) + 1)) AS p FROM {source})"]
    if start - jitter < 1:
        parts += [f"SELECT {columns}, concat('{'N' * c}', substr({seq}, {start}, {size - c})) AS cand, {start - c - 1} AS pos FROM {source}" for c in range(1, jitter + 1)]
    parts += [f"SELECT {columns}, concat(substr({seq}, {start + c}, {size - c}), '{'N' * c}') AS cand, {start + c} AS pos FROM {source} WHERE {start - 1 + size + jitter} > length({seq})" for c in range(1, jitter + 1)]
    return " UNION ALL ".join(parts)


@query(f"{BASE}, short AS (SELECT read_idx, substr(seq, 1, cast(6 + read_idx % 9 AS int)) AS seq FROM reads), a AS ({windows_sql(1, 8, 2, source='short')}), b AS ({windows_sql(11, 8, 2)}) SELECT 1 AS start, * FROM a UNION ALL SELECT 11 AS start, * FROM b")
def jitter_windows(spark, sf_dir):
    reads = X.flat_reads(spark, sf_dir)
    short = reads.select("read_idx", F.expr("substring(seq, 1, cast(6 + read_idx % 9 AS int))").alias("seq"))
    one = lambda df, start: df.select(F.lit(start).alias("start"), "read_idx", F.explode(V.jitter_windows("seq", start, start + 7, 2)).alias("w")).select("start", "read_idx", "w.*")
    return one(short, 1).unionByName(one(reads, 11))


_NEAR = "near AS (SELECT bc AS barcode, variant, min(n) AS n FROM (SELECT bc, bc AS variant, 0 AS n FROM wl UNION ALL SELECT bc, concat(substr(bc, 1, p - 1), b, substr(bc, p + 1)) AS variant, 1 AS n FROM wl, (SELECT cast(unnest(range(1, 9)) AS int) AS p), (SELECT unnest(['A', 'C', 'G', 'T', 'N']) AS b) WHERE substr(bc, p, 1) <> b) GROUP BY ALL)"


@query(f"{BASE}, {_NEAR} SELECT barcode, variant, n FROM near")
def mismatch_neighbourhood(spark, sf_dir):
    return M.neighbourhood(X.barcodes(spark, sf_dir), 1)


_APPROX = f"{BASE}, w AS ({windows_sql(11, 8, 2)}) SELECT read_idx, cand, pos, bc AS barcode, cast(hamming(cand, bc) AS int) AS n FROM w JOIN wl ON length(cand) = 8 AND hamming(cand, bc) <= 1"


def _approximate(strategy: str) -> Query:
    def run(spark, sf_dir):
        windows = X.flat_reads(spark, sf_dir).select("read_idx", F.explode(V.jitter_windows("seq", 11, 18, 2)).alias("w")).select("read_idx", "w.*")
        return M.approximate_matches(windows, X.barcodes(spark, sf_dir), 8, 1, strategy, barcodes=96).select("read_idx", "cand", "pos", "barcode", "n")

    return run


for _name, _strategy in (("approx_match_neighbourhood", "neighbourhood"), ("approx_match_seedindex", "seed"), ("approx_match_kmer", "kmer")):
    QUERIES[_name], SQL[_name] = _approximate(_strategy), _APPROX


def resolve_sql(windows: str, start: int, tie: str, mismatches: int = 1) -> str:
    """CTEs up to resolved(read_idx, barcode, n, pos) for windows w."""
    good = "count(DISTINCT barcode) = 1" + (" AND NOT (min(n) = 0 AND count(*) > 1)" if tie == "set" else "")
    return f"""w AS ({windows}),
hit AS (SELECT read_idx, bc AS barcode, pos, cast(hamming(cand, bc) AS int) AS n FROM w JOIN wl ON length(cand) = 8 AND hamming(cand, bc) <= {mismatches}),
far AS (SELECT *, CASE WHEN n > 0 AND pos < 1 THEN abs(pos + 1 - {start}) ELSE abs(pos - {start}) END AS dist FROM hit),
top AS (SELECT * FROM (SELECT *, rank() OVER (PARTITION BY read_idx ORDER BY n, dist) AS r FROM far) WHERE r = 1),
won AS (SELECT read_idx, min(barcode) AS barcode, min(n) AS n, CASE WHEN count(DISTINCT pos) = 1 THEN cast(min(pos) AS varchar) ELSE '*' END AS pos FROM top GROUP BY read_idx HAVING {good}),
resolved AS (SELECT read_idx, coalesce(barcode, 'NNNNNNNN') AS barcode, coalesce(n, -1) AS n, coalesce(pos, 'N') AS pos FROM reads LEFT JOIN won USING (read_idx))"""


def _second(ctes: str) -> str:
    """The same common table expressions under other names."""
    return re.sub(r"\b(w|hit|far|top|won|resolved)\b", r"\g<1>2", ctes)


def _resolve(tie: str) -> Query:
    def run(spark, sf_dir):
        out = E.match_barcodes(X.reads(spark, sf_dir), X.PLACES[:1], {"BC:v1": X.barcodes(spark, sf_dir)}, 2, 1, tie=tie)
        return out.select("read_idx", F.get("matched", F.lit(0)).alias("m")).select("read_idx", "m.barcode", "m.n", "m.pos")

    return run


for _tie in ("set", "index"):
    QUERIES[f"resolve_{_tie}"], SQL[f"resolve_{_tie}"] = _resolve(_tie), f"{BASE}, {resolve_sql(windows_sql(11, 8, 2), 11, _tie)} SELECT * FROM resolved"


@query(f"{BASE}, rev AS (SELECT read_idx, {RC.format('seq')} AS seq FROM reads), {resolve_sql(windows_sql(11, 8, 2, source='rev'), 11, 'set')} SELECT * FROM resolved")
def resolve_reverse(spark, sf_dir):
    place = E.BarcodePlace(0, 11, 18, "BC:v1", "reverse")
    out = E.match_barcodes(X.reads(spark, sf_dir), [place], {"BC:v1": X.barcodes(spark, sf_dir)}, 2, 1)
    return out.select("read_idx", F.get("matched", F.lit(0)).alias("m")).select("read_idx", "m.barcode", "m.n", "m.pos")


# ---- discovery -------------------------------------------------------------------------------------------------

_FREQ = "total AS (SELECT count(*) AS n FROM reads), base AS (SELECT p AS position, substr(seq, p, 1) AS b FROM (SELECT seq, unnest(range(1, length(seq) + 1)) AS p FROM reads)), freq AS (SELECT 0 AS file_index, cast(position AS int) AS position, " + ", ".join(f"count(*) FILTER (b = '{b}') / any_value(n) AS {b}" for b in "ACGTN") + " FROM base, total GROUP BY position)"


@query(f"{BASE}, {_FREQ} SELECT * FROM freq")
def base_frequencies(spark, sf_dir):
    return D.base_frequencies(X.flat_reads(spark, sf_dir).select(F.lit(0).alias("file_index"), "seq"))


_RUNS = """, m AS (SELECT position, greatest(A, C, G, T, N) AS f, CASE greatest(A, C, G, T, N) WHEN A THEN 'A' WHEN C THEN 'C' WHEN G THEN 'G' WHEN T THEN 'T' ELSE 'N' END AS b FROM freq),
r AS (SELECT *, position - row_number() OVER (ORDER BY position) AS run FROM m WHERE f >= 0.3),
conserved AS (SELECT 0 AS file_index, min(position) AS "start", max(position) AS "end", cast(count(*) AS int) AS length, string_agg(b, '' ORDER BY position) AS sequence, list_sort(list(f))[count(*) // 2 + 1] AS median_frequency FROM r GROUP BY run HAVING count(*) >= 8)"""


@query(f"{BASE}, {_FREQ}{_RUNS} SELECT * FROM conserved")
def conserved_runs(spark, sf_dir):
    return D.conserved_runs(base_frequencies(spark, sf_dir), 0.3, 8)


_HITS = f"""s AS (SELECT read_name, seq, 'forward' AS orientation, cast(length(seq) AS int) AS n FROM reads UNION ALL SELECT read_name, {RC.format('seq')}, 'reverse', cast(length(seq) AS int) FROM reads),
v AS (SELECT *, cast(unnest(range(1, n - 6)) AS int) AS p FROM s),
hits AS (SELECT 0 AS file_index, 'R1' AS file, read_name, n AS seqlen, 'BC:v1' AS barcode_whitelist, bc AS barcode, orientation, CASE orientation WHEN 'forward' THEN p ELSE n - p - 6 END AS "start", CASE orientation WHEN 'forward' THEN p ELSE n - p - 6 END + 7 AS "end", 0 AS mismatches FROM v JOIN wl ON substr(seq, p, 8) = bc)"""


def _hits(spark, sf_dir):
    reads = X.flat_reads(spark, sf_dir).select(F.lit(0).alias("file_index"), F.lit("R1").alias("file"), "read_name", "seq")
    return D.exact_hits(reads, X.barcodes(spark, sf_dir).withColumn("whitelist", F.lit("BC:v1")))


@query(f"{BASE}, {_HITS} SELECT * FROM hits")
def exact_match_seed(spark, sf_dir):
    return _hits(spark, sf_dir)


_SAMPLE = D.sample_ordinals(200, 1400)


@query(f"{BASE} SELECT read_idx, seq FROM reads WHERE read_idx IN ({', '.join(map(str, _SAMPLE))})")
def read_sample(spark, sf_dir):
    return D.sample_reads(X.flat_reads(spark, sf_dir).select("read_idx", "seq"), 200, 1400)


# ---- places from histograms ------------------------------------------------------------------------------------

_G = "file_index, file, barcode_whitelist, orientation"


@query(f'{BASE}, {_HITS} SELECT {_G}, "start", cast(count(*) AS bigint) AS count FROM hits GROUP BY ALL')
def start_histogram(spark, sf_dir):
    return P.start_histogram(_hits(spark, sf_dir))


_STATS = f"""{_HITS}, g AS (SELECT {_G}, count(DISTINCT read_name) AS reads, count(DISTINCT barcode) AS kinds, count(*) AS "rows" FROM hits GROUP BY ALL),
st AS (SELECT {_G}, "start", min("end") AS "end", cast(count(*) AS bigint) AS count, cast(count(DISTINCT read_name) AS bigint) AS read_count FROM hits GROUP BY ALL),
stats AS (SELECT {_G}, "start", "end", count, read_count, round(read_count / reads, 2) AS read_fraction, round(kinds / "rows", 4) AS barcode_diversity FROM st JOIN g USING ({_G}))"""


@query(f"{BASE}, {_STATS} SELECT * FROM stats")
def peak_stats(spark, sf_dir):
    return P.peak_statistics(_hits(spark, sf_dir))


_PEAKS = f"""{_STATS}, k AS (SELECT *, row_number() OVER o AS rnk, CASE WHEN count IS DISTINCT FROM lag(count) OVER o THEN 1 ELSE 0 END AS new FROM stats WINDOW o AS (PARTITION BY {_G} ORDER BY "start")),
isl AS (SELECT *, sum(new) OVER (PARTITION BY {_G} ORDER BY "start") AS island FROM k),
lev AS (SELECT {_G}, island, min(rnk) AS f, max(rnk) AS l, min(count) AS level FROM isl GROUP BY ALL),
nb AS (SELECT *, coalesce(lag(level) OVER q, 0) AS b, coalesce(lead(level) OVER q, 0) AS a, max(l) OVER (PARTITION BY {_G}) AS starts FROM lev WINDOW q AS (PARTITION BY {_G} ORDER BY island)),
peaks AS (SELECT {_G}, "start", "end", CASE WHEN starts = 1 THEN count ELSE read_count END AS read_count, CASE WHEN starts = 1 THEN 1.0 ELSE read_fraction END AS read_fraction, barcode_diversity, starts = 1 AS lone
  FROM isl JOIN (SELECT {_G}, (f + l) // 2 AS rnk, starts FROM nb WHERE level > b AND level > a) USING ({_G}, rnk))"""


@query(f"{BASE}, {_PEAKS} SELECT * EXCLUDE (lone) FROM peaks")
def peaks(spark, sf_dir):
    return P.find_peaks(_hits(spark, sf_dir))


@query(f'{BASE}, {_PEAKS}, {_FREQ}{_RUNS} SELECT * EXCLUDE (lone) FROM peaks p WHERE lone OR NOT EXISTS (SELECT 1 FROM conserved c WHERE c.file_index = p.file_index AND c."start" <= p."end" AND c."end" >= p."start")')
def peaks_masked(spark, sf_dir):
    return P.find_peaks(_hits(spark, sf_dir), conserved_runs(spark, sf_dir))


#: Three whitelists that share barcodes, so that their peaks overlap.
_LISTS = {"BC:v1": "id >= 0", "BC:v2": "id < 48", "BC:v3": "id % 3 = 0"}
_LISTS_SQL = "lists AS (" + " UNION ALL ".join(f"SELECT bc, '{n}' AS label FROM wl WHERE {c}" for n, c in _LISTS.items()) + ")"
_GREEDY = f"""ordered AS (SELECT *, row_number() OVER (ORDER BY read_count DESC, "start", {_G}) AS k FROM peaks),
greedy AS (SELECT cast(0 AS bigint) AS k, cast([] AS STRUCT(k bigint, w varchar, f int, a int, b int)[]) AS taken UNION ALL
  SELECT g.k + 1, CASE WHEN len(list_filter(g.taken, lambda t: t.w = p.barcode_whitelist OR (t.f = p.file_index AND t.a <= p."end" AND t.b >= p."start"))) > 0 THEN g.taken
    ELSE list_append(g.taken, {{'k': p.k, 'w': p.barcode_whitelist, 'f': p.file_index, 'a': p."start", 'b': p."end"}}) END FROM greedy g JOIN ordered p ON p.k = g.k + 1)"""


@query(f'{BASE}, {_LISTS_SQL}, {_PEAKS}, {_GREEDY} SELECT {_G}, "start", "end", read_count, read_fraction FROM ordered WHERE k IN (SELECT unnest(list_transform(taken, lambda t: t.k)) FROM (SELECT taken FROM greedy ORDER BY k DESC LIMIT 1))'.replace("WITH", "WITH RECURSIVE", 1).replace("'BC:v1' AS barcode_whitelist", "label AS barcode_whitelist").replace("JOIN wl ON substr(seq, p, 8) = bc", "JOIN lists ON substr(seq, p, 8) = bc"))
def greedy_positions(spark, sf_dir):
    reads = X.flat_reads(spark, sf_dir).select(F.lit(0).alias("file_index"), F.lit("R1").alias("file"), "read_name", "seq")
    lists = None
    for name, condition in _LISTS.items():
        part = X.whitelist(spark, sf_dir).where(condition).select(F.col("bc").alias("barcode"), F.lit(name).alias("whitelist"))
        lists = part if lists is None else lists.unionByName(part)
    return P.select_places(P.find_peaks(D.exact_hits(reads, lists)))


@query(f'{BASE}, {_HITS} SELECT *, cast(row_number() OVER (PARTITION BY file_index, read_name, orientation ORDER BY "start", barcode_whitelist, barcode) AS int) AS place FROM hits')
def hit_order(spark, sf_dir):
    return D.hit_order(_hits(spark, sf_dir))


@query(f'{BASE}, {_HITS} SELECT {_G}, floor("start" / 0.5) * 0.5 AS bin, cast(count(*) AS bigint) AS count FROM hits GROUP BY ALL')
def peak_histogram(spark, sf_dir):
    return P.histogram_bins(_hits(spark, sf_dir))


# ---- extraction ------------------------------------------------------------------------------------------------


def _records(spark, sf_dir, ordered=False, **more):
    return E.extract(X.reads(spark, sf_dir, ordered), X.PLACES, {"BC:v1": X.barcodes(spark, sf_dir)}, X.CDNA, X.UMI, **more)


def _xq(pos: str, size: int = 8) -> str:
    p = f"try_cast({pos} AS int)"
    return f"CASE WHEN {p} > 0 THEN rpad(substr(qual, greatest({p}, 1), {size}), {size}, '!') WHEN {p} < 0 THEN concat(repeat('!', least(-{p}, {size})), substr(qual, 1, greatest({size} + {p}, 0))) ELSE repeat('!', {size}) END"


def _extract_sql(source: str = "reads") -> str:
    one = resolve_sql(windows_sql(11, 8, 2, source=source), 11, "set")
    two = resolve_sql(windows_sql(37, 8, 2, source=source), 37, "set")
    two = _second(two)
    return f"""{one}, {two},
ext AS (SELECT read_idx, read_name, comment, substr(seq2, 1, 40) AS seq, substr(qual2, 1, 40) AS qual, concat(substr(seq, 11, 8), '_', substr(seq, 37, 8)) AS CR, concat(substr(qual, 11, 8), '_', substr(qual, 37, 8)) AS CY,
  concat(a.barcode, '_', b.barcode) AS CB, concat({_xq('a.pos')}, '_', {_xq('b.pos')}) AS XQ, concat(a.pos, '_', b.pos) AS XP, concat(cast(a.n AS varchar), '_', cast(b.n AS varchar)) AS XM,
  substr(seq, 45, 10) AS UR, substr(qual, 45, 10) AS UY, cast(CASE WHEN least(a.n, b.n) < 0 THEN least(a.n, 0) + least(b.n, 0) ELSE a.n + b.n END AS int) AS mismatches, NOT contains(concat(a.barcode, b.barcode), 'N') AS kept
  FROM reads JOIN resolved a USING (read_idx) JOIN resolved2 b USING (read_idx))"""


_EXT = f"{BASE}, {_extract_sql()}"


@query(f"{_EXT} SELECT * FROM ext")
def reap_records(spark, sf_dir):
    return _records(spark, sf_dir)


_ORDER = ("CR", "CY", "CB", "XQ", "XP", "XM", "UR", "UY")
_SAM_TEXT = "concat_ws(chr(9), read_name, '4', '*', '0', '255', '*', '*', '0', '0', seq, qual, " + ", ".join(f"concat('{t}:Z:', {t})" for t in _ORDER) + ")"


@query(f"{_EXT} SELECT read_idx, {_SAM_TEXT} AS value FROM ext")
def reap_sam(spark, sf_dir):
    return E.sam_lines(_records(spark, sf_dir))


_TAGTEXT = "concat_ws(' ', " + ", ".join(f"concat('{t}=', {t})" for t in _ORDER) + ")"


def _mate(mate: int, seq: str, qual: str) -> str:
    return f"concat_ws(chr(10), concat_ws(' ', concat('@', read_name), regexp_replace(regexp_replace(comment, '/[0-9]$', ''), 'length=[0-9]+', concat('length=', cast(length({seq}) AS varchar)), 'g'), concat({_TAGTEXT}, ' /{mate}')), {seq}, '+', {qual})"


@query(f"{_EXT} SELECT read_idx, concat_ws(chr(10), {_mate(1, 'concat(replace(CB, chr(95), chr(0)[:0]), UR)', 'concat(replace(XQ, chr(95), chr(0)[:0]), UY)')}, {_mate(2, 'seq', 'qual')}) AS value FROM ext".replace("chr(0)[:0]", "''"))
def reap_interleaved(spark, sf_dir):
    return E.interleaved(_records(spark, sf_dir))


@query(f"{_EXT} SELECT read_idx, CB, XP, UR FROM ext WHERE kept")
def reap_sifted(spark, sf_dir):
    return _records(spark, sf_dir, sift=True).select("read_idx", "CB", "XP", "UR")


@query(f"{_EXT} SELECT mismatches, cast(count(*) AS bigint) AS count FROM ext GROUP BY ALL")
def mismatch_stats(spark, sf_dir):
    return E.mismatch_counts(_records(spark, sf_dir))


@query(f"{_EXT} SELECT position, cast(count(*) AS bigint) AS count FROM (SELECT unnest(string_split(XP, '_')) AS position FROM ext) GROUP BY ALL")
def position_stats(spark, sf_dir):
    return E.position_counts(_records(spark, sf_dir))


_MASKED = f"masked AS (SELECT read_idx, {_MASK.replace('25', '12').format('seq', 'qual')} AS seq FROM reads)"


@query(f"{BASE}, {_MASKED}, {_extract_sql('masked')} SELECT read_idx, CB, XM, XP, CR, {_MASK.replace('25', '12').format('seq', 'qual')} AS seq FROM ext")
def reap_quality_masked(spark, sf_dir):
    return _records(spark, sf_dir, base_quality=12).select("read_idx", "CB", "XM", "XP", "CR", "seq")


@query(f"{_EXT} SELECT CB, XQ, mismatches FROM ext")
def matched_quality(spark, sf_dir):
    return _records(spark, sf_dir).select("CB", "XQ", "mismatches")


@query(f"{_EXT} SELECT cast(sum(c) AS bigint) AS valid FROM (SELECT mismatches, count(*) AS c FROM ext GROUP BY ALL) WHERE mismatches >= 0")
def valid_barcodes(spark, sf_dir):
    return C.valid_total(E.mismatch_counts(_records(spark, sf_dir)))


@query(f"{BASE} SELECT cast(count(*) AS bigint) AS reads FROM reads")
def read_counts(spark, sf_dir):
    return X.flat_reads(spark, sf_dir).agg(F.count(F.lit(1)).alias("reads"))


@query("""SELECT '0,0,8,0,8,16,0,16,24:0,24,34:1,0,0' AS x, '1:25-34' AS umi""")
def sidecar_json(spark, sf_dir):
    """The option and the UMI range of the description for three barcodes of 8 bases and a UMI of 10."""
    text = json.dumps(E.sidecar([8, 8, 8], 10))
    side = spark.createDataFrame([(text,)], "value string")
    return side.select(F.regexp_extract(F.get_json_object("value", "$['kallisto-bustools'][0]['kb count']"), r"-x ([^ ]+)", 1).alias("x"), F.get_json_object("value", "$.umi[0].range").alias("umi"))


# ---- tagged records --------------------------------------------------------------------------------------------


@query(f"{REC} SELECT line, CB FROM rec WHERE coalesce(CB, '') NOT LIKE '%N%'")
def sift_sam(spark, sf_dir):
    return R.sift_records(X.tagged(X.records(spark, sf_dir))).select("line", R.tag("CB").alias("CB"))


@query(f"{REC} SELECT line, r1_seq FROM (SELECT line, replace(coalesce(CB, CR), '_', '') AS r1_seq FROM rec) WHERE substr(r1_seq, 1, 8) NOT LIKE '%N%' AND substr(r1_seq, 9, 8) NOT LIKE '%N%'")
def sift_ranges(spark, sf_dir):
    pairs = X.records(spark, sf_dir).select("line", F.regexp_replace(F.coalesce("CB", "CR"), "_", "").alias("r1_seq"))
    return R.sift_reads(pairs, [(1, 8), (9, 16)])


_WEED = f"""{REC}, wl AS (SELECT substr({X.dna("concat('w', cast(p_partkey AS varchar(20)))")}, 1, 8) AS bc FROM part WHERE p_partkey BETWEEN 1 AND 96),
hd AS (SELECT concat('r', cast(i AS varchar)) AS read_name, CASE WHEN i % 4 = 0 THEN NULL WHEN i % 3 = 0 THEN {RC.format('bc')} WHEN i % 10 = 1 THEN concat(substr(bc, 1, 7), 'N') ELSE bc END AS raw
  FROM (SELECT o_orderkey AS i FROM orders) JOIN (SELECT p_partkey - 1 AS id, substr({X.dna("concat('w', cast(p_partkey AS varchar(20)))")}, 1, 8) AS bc FROM part WHERE p_partkey BETWEEN 1 AND 96) ON i % 96 = id),
kinds AS (SELECT DISTINCT raw FROM hd WHERE raw IS NOT NULL),
reads AS (SELECT raw AS read_idx, raw AS seq FROM kinds), {{one}}, rv AS (SELECT raw AS read_idx, {RC.format('raw')} AS seq FROM kinds), {{two}},
m AS (SELECT read_idx AS raw, CASE WHEN a.barcode LIKE '%NN%' THEN b.barcode ELSE a.barcode END AS barcode, CASE WHEN a.barcode LIKE '%NN%' THEN b.n ELSE a.n END AS n FROM resolved a JOIN resolved2 b USING (read_idx))
SELECT line, CASE WHEN read_name IS NULL THEN CR ELSE concat(CR, '_', coalesce(h.raw, '')) END AS CR, CASE WHEN read_name IS NULL THEN CB ELSE concat(coalesce(CB, ''), '_', CASE WHEN h.raw IS NULL THEN 'NN' ELSE barcode END) END AS CB,
  CASE WHEN read_name IS NULL THEN XM ELSE concat(XM, '_', CASE WHEN h.raw IS NULL THEN '' ELSE cast(n AS varchar) END) END AS XM, CASE WHEN read_name IS NULL THEN XP ELSE concat(XP, '_0') END AS XP, CASE WHEN read_name IS NULL THEN NULL ELSE concat('_', repeat('!', length(coalesce(h.raw, '')))) END AS CY
FROM rec LEFT JOIN hd h ON qname = read_name LEFT JOIN m ON h.raw = m.raw"""


def _weed_sql() -> str:
    one = resolve_sql(windows_sql(1, 8, 1), 1, "set")
    two = resolve_sql(windows_sql(1, 8, 1, source="rv"), 1, "set")
    return _WEED.replace("{one}", one).replace("{two}", _second(two))


@query(_weed_sql())
def weed_append(spark, sf_dir):
    wl = X.whitelist(spark, sf_dir)
    raw = F.when(F.col("i") % 4 == 0, None).when(F.col("i") % 3 == 0, S.reverse_complement("bc")).when(F.col("i") % 10 == 1, F.concat(F.substring("bc", 1, 7), F.lit("N"))).otherwise(F.col("bc"))
    headers = X.table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("i")).join(F.broadcast(wl), F.col("i") % 96 == F.col("id"))  # 96 rows
    described = F.when(raw.isNull(), F.lit("1:N:0:1")).otherwise(F.concat(F.lit("1:N:0:GG+"), raw))
    headers = headers.select(F.concat(F.lit("r"), F.col("i").cast("string")).alias("read_name"), described.alias("description"))
    out = R.append_header_barcode(X.tagged(X.records(spark, sf_dir)), headers, 2, X.barcodes(spark, sf_dir), 8)
    return out.select("line", *[R.tag(t).alias(t) for t in ("CR", "CB", "XM", "XP", "CY")])


_RAKE = f"""{REC}, v AS (SELECT qname, max_by(CB, line) AS cb FROM rec WHERE length(CB) = 17 AND replace(CB, 'N', '') <> '' GROUP BY qname),
q AS (SELECT concat('r', cast(i AS varchar)) AS read_name, substr({X.dna("concat('f', cast(i AS varchar(20)))")}, 1, cast(10 + i % 20 AS int)) AS seq FROM (SELECT o_orderkey AS i FROM orders))
SELECT read_name, CASE WHEN cb IS NOT NULL AND length(seq) >= 19 THEN concat(substr(seq, 1, 2), cb, substr(seq, 20)) ELSE seq END AS seq FROM q LEFT JOIN v ON read_name = qname"""


@query(_RAKE)
def rake_inject(spark, sf_dir):
    orders = X.table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"))
    reads = orders.select(F.expr("concat('r', cast(id AS string))").alias("read_name"), F.expr(f"substr({X.dna(X._key('f', 'id'))}, 1, cast(10 + id % 20 AS int))").alias("seq"))
    return R.inject_barcodes(reads, X.records(spark, sf_dir).select("line", "qname", F.col("CB").alias("cb")), 3, 17).select("read_name", "seq")


def _parts_sql(tag: str) -> str:
    return f"{REC} SELECT cast(i - 1 AS int) AS idx, string_split({tag}, '_')[i] AS value, cast(count(*) AS bigint) AS count FROM (SELECT {tag}, unnest(range(1, len(string_split({tag}, '_')) + 1)) AS i FROM rec WHERE {tag} IS NOT NULL) GROUP BY ALL"


def _stats(tag: str, split: bool = True) -> Query:
    return lambda spark, sf_dir: C.tag_counts(X.records(spark, sf_dir), tag, split)


for _tag in ("CR", "CB", "XP", "XM"):
    QUERIES[f"stats_{_tag.lower()}"], SQL[f"stats_{_tag.lower()}"] = _stats(_tag), _parts_sql(_tag)
QUERIES["stats_ur"], SQL["stats_ur"] = _stats("UR", False), f"{REC} SELECT 0 AS idx, UR AS value, cast(count(*) AS bigint) AS count FROM rec GROUP BY ALL"


@query(f"{REC} SELECT CB AS value, cast(count(*) AS bigint) AS count FROM rec WHERE CB IS NOT NULL GROUP BY ALL")
def stats_combined(spark, sf_dir):
    return C.value_counts(X.records(spark, sf_dir), "CB")


@query(f"{REC} SELECT try_cast(x AS int) AS mismatches, cast(count(*) AS bigint) AS count FROM (SELECT unnest(string_split(XM, '_')) AS x FROM rec) GROUP BY ALL")
def tally_mismatches(spark, sf_dir):
    return C.tally_mismatches(X.records(spark, sf_dir))


@query(f"{REC} SELECT cast(i - 1 AS int) AS idx, try_cast(string_split(XP, '_')[i] AS int) AS position, cast(count(*) AS bigint) AS count FROM (SELECT XP, unnest([1, 2]) AS i FROM rec) GROUP BY ALL")
def tally_positions(spark, sf_dir):
    return C.tally_positions(X.records(spark, sf_dir))


@query(f"{REC} SELECT cast(count(*) AS bigint) AS reads, cast(count(*) FILTER (CB IS NOT NULL AND CB NOT LIKE '%N%') AS bigint) AS valid, cast(count(*) FILTER (XM = '0_0') AS bigint) + cast(count(*) FILTER (XM = '-1_1') AS bigint) AS perfect, cast(count(DISTINCT CB) AS bigint) AS combinations FROM rec")
def tally_summary(spark, sf_dir):
    return C.tally_summary(X.records(spark, sf_dir))


@query(f"{REC} SELECT CB, cast(count(*) AS bigint) AS count FROM rec WHERE CB IS NOT NULL GROUP BY ALL")
def tally_barcodes(spark, sf_dir):
    rec = X.records(spark, sf_dir)
    return C.barcode_tally(rec.select(F.concat_ws(" ", F.concat(F.lit("@"), F.col("qname")), F.concat(F.lit("CB="), F.col("CB")), F.lit("/1")).alias("value")))


@query(f"{REC} SELECT qname AS read_name, concat(replace(coalesce(CB, ''), '_', ''), UR) AS r1_seq, concat(repeat('F', length(replace(coalesce(CB, ''), '_', ''))), repeat('F', length(UR))) AS r1_qual, seq AS r2_seq, qual AS r2_qual FROM rec")
def recast_fastq(spark, sf_dir):
    return R.records_to_interleaved(X.tagged(X.records(spark, sf_dir))).drop("tags_text")


@query(f"{REC} SELECT qname, 4 AS flag, seq, qual, CB, XM FROM rec")
def recast_sam(spark, sf_dir):
    rec = X.records(spark, sf_dir)
    header = F.concat_ws(" ", F.concat(F.lit("@"), F.col("qname")), F.concat(F.lit("CB="), F.col("CB")), F.concat(F.lit("XM="), F.col("XM"), F.lit("/2")))
    out = R.interleaved_to_records(rec.select(header.alias("header"), F.col("seq").alias("r2_seq"), F.col("qual").alias("r2_qual")))
    return out.select("qname", "flag", "seq", "qual", R.tag("CB").alias("CB"), R.tag("XM").alias("XM"))


@query(f"{REC} SELECT qname, CB, XM, XP FROM rec")
def samtags(spark, sf_dir):
    return X.tagged(X.records(spark, sf_dir)).select("qname", *[R.tag(t).alias(t) for t in ("CB", "XM", "XP")])


@query(f"{REC} SELECT qname, max(line) AS line, max_by(CR, line) AS CR FROM rec GROUP BY qname")
def last_record(spark, sf_dir):
    return R.last_by_name(X.records(spark, sf_dir)).select("qname", "line", "CR")


# ---- what comes after ------------------------------------------------------------------------------------------


@query(f"{REC}, cells AS (SELECT CB FROM (SELECT DISTINCT CB FROM rec WHERE CB IS NOT NULL) ORDER BY md5(concat('0:', CB)), CB LIMIT 100) SELECT line, qname FROM rec WHERE qname IN (SELECT qname FROM rec WHERE CB IN (SELECT CB FROM cells))")
def read_reassignment(spark, sf_dir):
    rec = X.records(spark, sf_dir)
    return C.reads_of_cells(rec.select("qname", "CB"), rec.select("line", "qname"), n=100)


_COUNTS = "u AS (SELECT concat('c', cast(l_suppkey % 40 AS varchar)) AS cell, concat('g', cast(l_partkey % 60 AS varchar)) AS gene, concat(cast(l_orderkey % 50 AS varchar), l_returnflag) AS umi FROM lineitem), cnt AS (SELECT cell, gene, cast(count(DISTINCT umi) AS bigint) AS count FROM u GROUP BY ALL)"


def _counts(spark, sf_dir):
    return C.umi_counts(X.table(spark, sf_dir, "lineitem").select(F.expr("concat('c', cast(l_suppkey % 40 AS string))").alias("cell"), F.expr("concat('g', cast(l_partkey % 60 AS string))").alias("gene"), F.expr("concat(cast(l_orderkey % 50 AS string), l_returnflag)").alias("umi")))


@query(f"WITH {_COUNTS} SELECT * FROM cnt")
def umi_counts(spark, sf_dir):
    return _counts(spark, sf_dir)


@query(f"WITH {_COUNTS} SELECT gene, " + ", ".join(f"coalesce(sum(count) FILTER (cell = 'c{i}'), 0)::bigint AS c{i}" for i in range(40)) + " FROM cnt GROUP BY gene HAVING count(*) > 0")
def umi_matrix(spark, sf_dir):
    return C.wide_counts(_counts(spark, sf_dir), [f"c{i}" for i in range(40)])


@query(f"WITH {_COUNTS}, a AS (SELECT cell, row_number() OVER (ORDER BY cell) AS i FROM (SELECT DISTINCT cell FROM cnt)), b AS (SELECT gene, row_number() OVER (ORDER BY gene) AS j FROM (SELECT DISTINCT gene FROM cnt)) SELECT i AS \"row\", j AS col, count AS val FROM cnt JOIN a USING (cell) JOIN b USING (gene)")
def counts_to_coo(spark, sf_dir):
    return C.counts_to_coo(_counts(spark, sf_dir))


@query(f"WITH {_COUNTS} SELECT * FROM cnt WHERE gene IN (SELECT gene FROM cnt GROUP BY gene HAVING sum(count) >= 100) AND cell IN (SELECT cell FROM cnt GROUP BY cell HAVING sum(count) >= 150)")
def totals_filter(spark, sf_dir):
    counts = _counts(spark, sf_dir)
    genes = C.filter_totals(counts, 100)
    cells = counts.groupBy("cell").agg(F.sum("count").alias("t")).where("t >= 150").select("cell")
    return genes.join(cells, "cell", "left_semi").select("cell", "gene", "count")


@query("SELECT DISTINCT l_suppkey AS id FROM lineitem WHERE l_returnflag = 'R' INTERSECT SELECT DISTINCT l_suppkey AS id FROM lineitem WHERE l_linestatus = 'O'")
def common_cells(spark, sf_dir):
    line = X.table(spark, sf_dir, "lineitem")
    return C.common_names(line.where("l_returnflag = 'R'").select(F.col("l_suppkey").alias("id")), line.where("l_linestatus = 'O'").select(F.col("l_suppkey").alias("id")), "id")


@query("""WITH d AS (SELECT q.vec_id AS query, p.vec_id AS neighbour, list_sum(list_transform(list_zip(p.embedding, q.embedding), lambda x: (cast(x[1] AS double) - cast(x[2] AS double)) * (cast(x[1] AS double) - cast(x[2] AS double)))) AS d
FROM embeddings p, embeddings q WHERE q.vec_id % 50 = 0 AND p.vec_id <> q.vec_id), r AS (SELECT *, row_number() OVER (PARTITION BY query ORDER BY d, neighbour) AS k FROM d)
SELECT query, neighbour, round(d, 6) AS distance, cast(k AS int) AS "rank" FROM r WHERE k <= 5""")
def knn(spark, sf_dir):
    points = X.table(spark, sf_dir, "embeddings")
    out = C.nearest(points, points.where("vec_id % 50 = 0").select("vec_id", "embedding"), 5, "vec_id", "embedding")
    return out.select("query", "neighbour", F.round("distance", 6).alias("distance"), "rank")


@query("SELECT min(p_partkey) AS line, min_by(p_name, p_partkey) AS name, p_brand AS seq FROM part GROUP BY p_brand")
def dedup_contaminants(spark, sf_dir):
    part = X.table(spark, sf_dir, "part")
    return C.first_by_sequence(part.select(F.col("p_partkey").alias("line"), F.col("p_name").alias("name"), F.col("p_brand").alias("seq")))


@query(f"{REC} SELECT cast(count(*) AS bigint) AS reads, cast(count(*) FILTER (CB IS NULL) AS bigint) AS missing_cb, cast(count(*) FILTER (CB <> CR) AS bigint) AS corrected FROM rec")
def missing_cb(spark, sf_dir):
    rec = X.records(spark, sf_dir)
    return C.missing_barcodes(rec.withColumn("CB", F.concat("CB", F.lit("-1"))))


@query(f"{BASE} SELECT cast(count(*) AS bigint) AS barcodes, 8 AS length, cast(2 * count(*) AS bigint) AS seeds, cast((SELECT count(*) FROM (SELECT DISTINCT bc, substr(bc, i, 4) AS k FROM wl, (SELECT cast(unnest(range(1, 6)) AS int) AS i))) AS bigint) AS kmers FROM wl")
def index_summary(spark, sf_dir):
    wl = X.barcodes(spark, sf_dir)
    seeds, kmers = M.seed_index(wl, 8, 1).agg(F.count(F.lit(1)).alias("seeds")), M.kmer_index(wl, 8, 1).agg(F.count(F.lit(1)).alias("kmers"))
    one = wl.agg(F.count(F.lit(1)).alias("barcodes"), F.max(F.length("barcode")).alias("length"))
    return one.join(F.broadcast(seeds)).join(F.broadcast(kmers))  # one row each


# ---- files: written, read back, compared with the tables they come from ------------------------------------------


def _fastq_lines(reads: DataFrame, seq: str, qual: str) -> DataFrame:
    return reads.select("read_idx", F.concat_ws("\n", F.concat_ws(" ", F.concat(F.lit("@"), F.col("read_name")), "comment"), seq, F.lit("+"), qual).alias("value"))


@query(f"{BASE} SELECT read_name, comment, seq, qual FROM reads")
def fastq_files(spark, sf_dir):
    """FASTQ text in several files, read in ranges smaller than a file."""
    path = scratch(spark, "fastq")
    Z.write_lines(_fastq_lines(X.flat_reads(spark, sf_dir, ordered=True), "seq", "qual"), path)
    return Z.read_fastq(spark, *part_files(path), range_bytes=1 << 20).select("read_name", "comment", "seq", "qual")


@query(f"{BASE} SELECT cast(row_number() OVER (ORDER BY read_idx) - 1 AS bigint) AS ordinal, read_name, seq, seq2 FROM reads")
def fastq_pairs(spark, sf_dir):
    """Two mates' files, one of them gzip, zipped by ordinal; a mate's file is one by its nature, in parts whose ordinals run on."""
    one, two = scratch(spark, "mate1"), scratch(spark, "mate2")
    reads = X.flat_reads(spark, sf_dir, ordered=True)
    Z.write_lines(_fastq_lines(reads, "seq", "qual"), one)
    Z.write_lines(_fastq_lines(reads, "seq2", "qual2"), two, compression="gzip")
    pairs = Z.zip_reads(Z.read_fastq(spark, part_files(one), part_files(two), range_bytes=1 << 20), 2)
    return pairs.select(F.col("read_idx").alias("ordinal"), "read_name", F.get("seqs", F.lit(0)).alias("seq"), F.get("seqs", F.lit(1)).alias("seq2"))


@query(f"{_EXT} SELECT read_name, concat(replace(CB, '_', ''), UR) AS r1_seq, seq AS r2_seq, qual AS r2_qual, CB, XM FROM ext")
def interleaved_file(spark, sf_dir):
    path = scratch(spark, "interleaved")
    Z.write_lines(E.interleaved(_records(spark, sf_dir, ordered=True)), path)
    out = Z.read_interleaved(spark, *part_files(path))
    out = out.select("*", S.header_words("header").alias("words"))
    return out.select(F.expr("substring(split(header, ' ', 2)[0], 2)").alias("read_name"), "r1_seq", "r2_seq", "r2_qual", *[S.header_tag("words", t).alias(t) for t in ("CB", "XM")])


@query(f"{_EXT} SELECT read_name AS qname, seq, qual, {', '.join(_ORDER)} FROM ext")
def sam_file(spark, sf_dir):
    path = scratch(spark, "sam")
    Z.write_sam(E.sam_lines(_records(spark, sf_dir, ordered=True)), path, "reap")
    return Z.read_sam(spark, path).select("qname", "seq", "qual", *[R.tag(t).alias(t) for t in _ORDER])


@query(f"{BASE} SELECT bc AS barcode FROM wl GROUP BY bc")
def whitelist_file(spark, sf_dir):
    """A file with each barcode twice, blanks around them, and blank lines."""
    path = scratch(spark, "whitelist")
    lines = X.barcodes(spark, sf_dir).select(F.explode(F.array("barcode", F.concat(F.lit(" "), F.col("barcode"), F.lit(" ")), F.lit(""))).alias("value"))
    Z.write_lines(lines, path, order=None)
    return Z.read_whitelists(spark, [f"BC:v1:{path}"])["BC:v1"]


@query(f"{BASE}, {_HITS} SELECT * FROM hits")
def hits_file(spark, sf_dir):
    path = scratch(spark, "hits")
    Z.write_csv(_hits(spark, sf_dir), path, "\t")
    return Z.read_hits(spark, path)


@query(f"{BASE}, {_FREQ}{_RUNS} SELECT * FROM conserved")
def conserved_file(spark, sf_dir):
    path = scratch(spark, "conserved")
    Z.write_csv(conserved_runs(spark, sf_dir), path, "\t", ["file_index", "start"])
    return Z.read_conserved(spark, path)


@query(f"{BASE}, {_FREQ} SELECT 'file0' AS read, position, A, C, G, T, N FROM freq")
def frequencies_file(spark, sf_dir):
    path = scratch(spark, "frequencies")
    shown = base_frequencies(spark, sf_dir).select(F.concat(F.lit("file"), F.col("file_index").cast("string")).alias("read"), "position", *"ACGTN")
    Z.write_csv(shown, path, "\t", ["read", "position"])
    return Z.read_frequencies(spark, path)


@query(SQL["greedy_positions"].replace(f'SELECT {_G}, "start", "end", read_count, read_fraction FROM ordered', 'SELECT file_index AS file, "start", "end", barcode_whitelist AS whitelist, orientation FROM ordered'))
def places_file(spark, sf_dir):
    path = scratch(spark, "places")
    columns = ["barcode_whitelist", "file_index", "file", "orientation", "start", "end", "read_count", "read_fraction"]
    Z.write_csv(greedy_positions(spark, sf_dir).select(*columns), path, order=[F.desc("read_count"), "start"])
    places = [(p.file, p.start, p.end, p.whitelist, p.orientation) for p in Z.read_places(spark, path)]
    return spark.createDataFrame(places, "file int, start int, end int, whitelist string, orientation string")


@query("SELECT min_by(p_name, p_partkey) AS name, p_brand AS seq FROM part GROUP BY p_brand")
def fasta_file(spark, sf_dir):
    """The names of distinct sequences of a FASTA file, the first of each."""
    path = scratch(spark, "fasta")
    part = X.table(spark, sf_dir, "part").coalesce(1).sortWithinPartitions("p_partkey")  # read whole, as such files are
    Z.write_lines(part.select(F.concat_ws("\n", F.concat(F.lit(">"), F.col("p_name")), "p_brand").alias("value")), path, order=None)
    return C.first_by_sequence(Z.read_fasta(spark, path)).select("name", "seq")


@query(SQL["counts_to_coo"])
def matrix_market_file(spark, sf_dir):
    path = scratch(spark, "matrix")
    coo = stored(counts_to_coo(spark, sf_dir), "coo")
    size = coo.agg(F.max("row").alias("r"), F.max("col").alias("c")).first()
    Z.write_matrix_market(coo, size.r, size.c, path)
    return Z.read_matrix_market(spark, path)


@query(f"SELECT concat('Index ', cast(idx AS varchar), chr(9), value, chr(9), cast(count AS varchar)) AS value FROM ({_parts_sql('CB')})")
def tag_count_file(spark, sf_dir):
    path = scratch(spark, "counts")
    Z.write_tag_counts(C.tag_counts(X.records(spark, sf_dir), "CB"), path)
    return spark.read.text(path)


@query(f"{REC}, p AS (SELECT cast(i AS int) AS i, string_split(CB, '_')[i] AS b FROM (SELECT CB, unnest([1, 2]) AS i FROM rec WHERE CB IS NOT NULL)) SELECT 'barcodes' AS kind, i AS \"Index\", b AS value, cast(count(*) AS bigint) AS \"Count\" FROM p GROUP BY ALL UNION ALL SELECT 'combinations', 0, CB, cast(count(*) AS bigint) FROM rec WHERE CB IS NOT NULL GROUP BY ALL")
def tally_files(spark, sf_dir):
    tables = C.tally_tables(X.records(spark, sf_dir))
    found = {}
    for suffix in ("barcodes", "barcode.combinations"):
        path = scratch(spark, suffix)
        Z.write_csv(tables[suffix], path, order=tables[suffix].columns)
        found[suffix] = spark.read.schema(tables[suffix].schema).csv(path, header=True)
    one = found["barcodes"].select(F.lit("barcodes").alias("kind"), "Index", F.col("Barcode").alias("value"), "Count")
    return one.unionByName(found["barcode.combinations"].select(F.lit("combinations").alias("kind"), F.lit(0).alias("Index"), F.col("BarcodeCombination").alias("value"), "Count"))


@query(_APPROX)
def index_match(spark, sf_dir):
    """Windows matched through a stored index of seeds."""
    path = scratch(spark, "index")
    I.save_index(X.barcodes(spark, sf_dir), "BC:v1", path, "seed", 1)
    _, kind, mismatches, rows = I.load_index(spark, path)
    windows = X.flat_reads(spark, sf_dir).select("read_idx", F.explode(V.jitter_windows("seq", 11, 18, 2)).alias("w")).select("read_idx", "w.*")
    return M.approximate_matches(windows, X.barcodes(spark, sf_dir), 8, mismatches, index=(kind, rows)).select("read_idx", "cand", "pos", "barcode", "n")


@query(f"{BASE}, k AS (SELECT DISTINCT substr(bc, i, 4) AS k FROM wl, (SELECT cast(unnest(range(1, 6)) AS int) AS i)) SELECT 8 AS len, (SELECT string_agg(bc, ' ' ORDER BY bc) FROM (SELECT bc FROM wl ORDER BY bc LIMIT 3)) AS barcodes, (SELECT string_agg(k, ' ' ORDER BY k) FROM (SELECT k FROM k ORDER BY k LIMIT 3)) AS keys")
def index_preview(spark, sf_dir):
    out = I.preview_index(I.build_index(X.barcodes(spark, sf_dir), "kmer", 1))
    return out.select("len", *[F.array_join(c, " ").alias(c) for c in ("barcodes", "keys")])


@query(SQL["sift_ranges"])
def sift_by_sidecar(spark, sf_dir):
    """Reads sifted by the ranges of a description that was written and read back."""
    path = scratch(spark, "sidecar")
    Z.write_sidecar(spark, E.sidecar([8, 8], 3), path)
    pairs = X.records(spark, sf_dir).select("line", F.regexp_replace(F.coalesce("CB", "CR"), "_", "").alias("r1_seq"))
    return R.sift_reads(pairs, Z.sidecar_ranges(Z.read_sidecar(spark, path)))


@query(f"{REC} SELECT qname, concat_ws(chr(10), concat('@', qname, '/1'), concat(coalesce(CB, ''), UR), '+', concat(repeat('F', length(coalesce(CB, ''))), repeat('F', length(UR))), concat('@', qname, '/2'), seq, '+', qual) AS value FROM rec")
def sam_to_fastq(spark, sf_dir):
    return R.records_to_plain_interleaved(X.tagged(X.records(spark, sf_dir)))


@query(f"{REC}, c AS (SELECT string_split(min_by(CB, line), '_') AS p FROM rec WHERE CB IS NOT NULL) SELECT concat('0,0,', cast(len(p[1]) AS varchar), ',0,', cast(len(p[1]) AS varchar), ',', cast(len(p[1]) + len(p[2]) AS varchar), ':0,', cast(len(p[1]) + len(p[2]) AS varchar), ',', cast(len(p[1]) + len(p[2]) + (SELECT length(min_by(UR, line)) FROM rec) AS varchar), ':1,0,0') AS x FROM c")
def sidecar_of_records(spark, sf_dir):
    """The description that the first record with a barcode leads to, written and read back."""
    path = scratch(spark, "description")
    Z.write_sidecar(spark, E.sidecar(*R.sidecar_lengths(X.records(spark, sf_dir))), path)
    return C.kb_option(spark.read.text(path, wholetext=True))


@query(f"{REC} SELECT line AS read_idx, CR, CB, XM, concat(XP, '/1') AS XP, UR FROM rec")
def header_stats_tags(spark, sf_dir):
    rec = X.records(spark, sf_dir)
    names = ("CR", "CB", "XM", "XP", "UR")
    header = F.concat_ws(" ", F.lit("@x"), *[F.concat(F.lit(f"{n}="), F.col(n), F.lit("/1" if n == "XP" else "")) for n in names], F.lit("ZZ=1 /1"))
    return R.header_records(rec.select(F.col("line").alias("read_idx"), header.alias("header")), names)


@query("WITH " + X.BASE + "," + X.RECORDS + " SELECT read_idx FROM reads WHERE read_name IN (SELECT qname FROM rec WHERE CB IS NULL)")
def reads_without_barcode(spark, sf_dir):
    reads = X.flat_reads(spark, sf_dir).select("read_idx", "read_name")
    return C.reads_without_barcode(reads, X.records(spark, sf_dir).select("qname", "CB")).select("read_idx")


@query(f"{BASE}, {_NEAR} SELECT variant, barcode, n FROM (SELECT *, row_number() OVER (PARTITION BY variant ORDER BY n, id) AS k FROM near JOIN wl ON barcode = bc) WHERE k = 1")
def first_lookup(spark, sf_dir):
    return D.first_lookup(X.whitelist(spark, sf_dir).select(F.col("bc").alias("barcode"), F.col("id").alias("order")))

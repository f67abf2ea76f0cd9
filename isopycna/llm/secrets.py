"""Secret scans: pattern spans plus runs of high entropy, in DataFrame functions only.

Spans are half-open ranges of code points ``kind:start:end``.

* ``assign`` a keyword, ``:`` or ``=``, and a value of 12 or more characters;
* ``access`` a key id of 18 or more characters;
* ``hex`` 16 or more lower-case hexadecimal digits;
* ``entropy`` a candidate string (a run of 20 or more characters of a
  credential alphabet outside the assign spans) of which some window of 20 characters has
  a Shannon entropy over the threshold of its character class.  The window slides by one
  character; counts and the sum of ``c*log2(c)`` are updated, never recounted.
  Candidates on the allow list are suppressed: those without a digit, addresses and
  paths, one character over and over, numbers, and those that are as a whole an access or
  hex span already.  A candidate that merely contains such a span is judged and reported
  as a whole, so that nothing of it stays when spans are masked.

Null texts count as empty; an empty text has no spans; rows that repeat are
scanned each for itself; other columns, of whatever names, are kept by ``scan`` and
``redact`` and ignored by the query.  An empty table gives no rows.  Texts are scanned
whole.  The plan has no shuffle, and time grows in proportion to the length of a text, of
its candidates and to the number of matches: sums over matches are taken in blocks of
``BLOCK``, and each character of a candidate is looked at once.
"""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import documents

ASSIGN = r"""(?:[pP][aA][sS][sS][wW][oO][rR][dD]|[pP][aA][sS][sS][wW][dD]|[sS][eE][cC][rR][eE][tT]|[tT][oO][kK][eE][nN]|[aA][pP][iI]_?[kK][eE][yY])["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]{14,}"
HEX = r"[0-9a-f]{16,}"

WINDOW = 20
CANDIDATE = r"[A-Za-z0-9+/_=-]{20,}"
#: Class: (full match, alphabet, bits per character over which a window counts as random).
CLASSES = {
    "hex": (r"^[0-9a-fA-F]+$", "0123456789abcdefABCDEF", 3.0),
    "base32": (r"^[A-Z2-7=]+$", "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567=", 3.4),
    "base64": (r"^[A-Za-z0-9+/_=-]+$", "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_=-", 3.7),
}
#: Candidates that are suppressed: no digit at all, addresses and paths, one character over and over.
ALLOWED = (r"^[^0-9]+$", r"^[a-z]*/?/[a-z0-9_/-]+$", r"^(.)\1+$", r"^[0-9=_-]+$")


#: Slack of the threshold, for sums are kept by differences.
ROUNDING = 1e-6
#: Matches that are summed up one after the other; sums of blocks are added after that.
BLOCK = 256


def _let(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use(value)``, with ``value`` evaluated once however often ``use`` refers to it."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def _in_blocks(values: Column, use: Callable[[Column], Column]) -> Column:
    """``use`` of each ``BLOCK`` values; of no values, of one empty block."""
    return F.transform(F.sequence(F.lit(0), F.greatest(F.lit(0), F.floor((F.size(values) - 1) / BLOCK).cast("int"))), lambda b: use(F.slice(values, b * BLOCK + 1, BLOCK)))


def running(values: Column, combine: Callable[[Column, Column], Column]) -> Column:
    """Of an array of ints, what ``combine`` makes of the values up to each; two-level, so that no long array is copied for each value."""
    none = F.array().cast("array<int>")
    one_by_one = lambda block: F.aggregate(block, none, lambda acc, x: F.concat(acc, F.array(F.when(F.size(acc) > 0, combine(F.try_element_at(acc, F.lit(-1)), x)).otherwise(x))))
    shifted = lambda blocks, tops: F.transform(blocks, lambda block, i: F.when(i == 0, block).otherwise(F.transform(block, lambda x: combine(F.get(tops, i - 1), x))))
    last = lambda blocks: F.transform(blocks, lambda block: F.try_element_at(block, F.lit(-1)))
    return _let(values, lambda v: _let(_in_blocks(v, one_by_one), lambda blocks: F.flatten(_let(one_by_one(last(blocks)), lambda tops: shifted(blocks, tops)))))


def _spans(text: Column, pattern: str, kind: str) -> Column:
    """Array of struct(s, k, e, kind, m, gap) of the matches of ``pattern``; ``gap`` is the text between a match and the one before."""
    rank = {"assign": 0, "access": 1, "hex": 2, "entropy": 3}[kind]
    none = F.array().cast("array<struct<s:int,k:int,e:int,kind:string,m:string,gap:string>>")
    # There is one gap more than matches, after the last.
    pairs = F.arrays_zip(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)).alias("m"), F.split(text, pattern, -1).alias("gap"))
    matches = F.filter(pairs, lambda x: x["m"].isNotNull())
    ends = lambda ms: running(F.transform(ms, lambda x: F.length(x["gap"]) + F.length(x["m"])), lambda x, y: x + y)
    span = lambda x: F.struct(
        (x["e"] - F.length(x["x"]["m"])).alias("s"), F.lit(rank).alias("k"), x["e"].alias("e"), F.lit(kind).alias("kind"), x["x"]["m"].alias("m"), x["x"]["gap"].alias("gap")
    )
    found = _let(matches, lambda ms: F.transform(F.arrays_zip(ms.alias("x"), ends(ms).alias("e")), span))
    return F.when(F.regexp_like(text, F.lit(pattern)), found).otherwise(none)


def _long_value(x: Column) -> Column:
    return F.length(F.regexp_extract(x["m"], ASSIGN, 1)) >= 12


def window_entropy(s: Column, alphabet: str, window: int = WINDOW) -> Column:
    """Largest Shannon entropy, in bits per character, of any ``window`` characters of ``s``; 0 if ``s`` is shorter.

    One pass: the character that enters raises its count, the one that leaves
    lowers its own, and the running sum of ``c*log2(c)`` follows.  The counts are a
    string with one character for each of the alphabet, of which two are overwritten.
    """
    zero = ord("A")
    terms = F.array(*(F.lit(c * math.log2(c) if c else 0.0) for c in range(window + 2)))
    term = lambda c: F.get(terms, c)
    count = lambda n, at: F.ascii(F.substring(n, at, F.lit(1))) - zero
    put = lambda n, at, c: F.overlay(n, F.char(c + zero), at, F.lit(1))

    def step(acc: Column, x: Column) -> Column:
        come, go = x["come"], x["go"]
        entered = _let(
            F.struct(acc["n"].alias("n"), count(acc["n"], come).alias("up"), acc["t"].alias("t"), (acc["i"] + 1).alias("i"), acc["best"].alias("best")),
            lambda a: F.struct(put(a["n"], come, a["up"] + 1).alias("n"), (a["t"] + term(a["up"] + 1) - term(a["up"])).alias("t"), a["i"].alias("i"), a["best"].alias("best")),
        )
        left = lambda a: F.when(a["i"] <= window, a).otherwise(
            _let(
                count(a["n"], go),
                lambda down: F.struct(put(a["n"], go, down - 1).alias("n"), (a["t"] + term(down - 1) - term(down)).alias("t"), a["i"].alias("i"), a["best"].alias("best")),
            )
        )
        judged = lambda a: F.struct(a["n"].alias("n"), a["t"].alias("t"), a["i"].alias("i"), F.when(a["i"] >= window, F.least(a["best"], a["t"])).otherwise(a["best"]).alias("best"))
        return _let(_let(entered, left), judged)

    codes = F.transform(F.split(s, ""), lambda c: F.instr(F.lit(alphabet), c))
    lagged = lambda c: F.concat(F.array_repeat(F.lit(0), window), F.slice(c, 1, F.greatest(F.lit(0), F.size(c) - window)))
    steps = _let(codes, lambda c: F.arrays_zip(c.alias("come"), lagged(c).alias("go")))
    # The greatest entropy is the least sum; a window of one character has the greatest sum.
    most = window * math.log2(window)
    first = F.struct(F.lit(chr(zero) * len(alphabet)).alias("n"), F.lit(0.0).alias("t"), F.lit(0).alias("i"), F.lit(most).alias("best"))
    return F.when(F.length(s) >= window, F.lit(math.log2(window)) - F.aggregate(steps, first, step, lambda acc: acc["best"]) / window).otherwise(0.0)


def _suspicious(s: Column) -> Column:
    allowed = F.lit(False)
    for pattern in (*ALLOWED, f"^(?:{ACCESS}|{HEX})$"):
        allowed = allowed | F.regexp_like(s, F.lit(pattern))
    verdict = F.lit(False)
    for pattern, alphabet, bits in reversed(CLASSES.values()):
        verdict = F.when(F.regexp_like(s, F.lit(pattern)), window_entropy(s, alphabet) >= bits - ROUNDING).otherwise(verdict)
    return F.when(allowed, F.lit(False)).otherwise(verdict)


def _scanned(text: Column) -> Column:
    """Array of struct(s, k, e, kind, m) of all spans of ``text``, by start, then kind."""
    plain = lambda spans: F.transform(spans, lambda x: F.struct(*(x[c].alias(c) for c in ("s", "k", "e", "kind", "m"))))
    # The assign spans as blanks, the rest as it is: candidates keep their places.
    piece = lambda x: F.concat(x["gap"], F.when(_long_value(x), F.repeat(F.lit(" "), F.length(x["m"]))).otherwise(x["m"]))
    after = lambda t, all_: F.substr(t, F.try_element_at(all_, F.lit(-1))["e"] + 1)
    rest = lambda t, all_: F.when(F.size(all_) > 0, F.concat(F.array_join(F.transform(all_, piece), ""), after(t, all_))).otherwise(t)
    random = lambda t, all_: F.filter(_let(rest(t, all_), lambda r: _spans(r, CANDIDATE, "entropy")), lambda x: _suspicious(x["m"]))
    every = lambda t, all_: F.concat(
        plain(F.filter(all_, _long_value)), plain(_spans(t, ACCESS, "access")), plain(_spans(t, HEX, "hex")), plain(random(t, all_))
    )
    return _let(text, lambda t: F.array_sort(_let(_spans(t, ASSIGN, "assign"), lambda all_: every(t, all_))))


def scan(docs: DataFrame, text: str = "text") -> DataFrame:
    """``docs`` with ``secret_spans`` (in place of a column of that name), an array of struct(s, k, e, kind, m) by start, then kind.

    ``s`` and ``e`` bound the span in code points, ``k`` ranks the kind and
    ``m`` is the text found.
    """
    return docs.withColumn("secret_spans", _scanned(F.coalesce(F.col(text), F.lit(""))))


def _masked(text: Column, spans: Column) -> Column:
    """``text`` with ``[SECRET]`` for each span; spans that overlap or touch are one.

    A block of spans is cut out of the text once, and its pieces out of the block.
    """
    reach = lambda xs: running(F.transform(xs, lambda x: x["e"]), lambda x, y: F.greatest(x, y))
    # ``at``: how far the spans before reach.
    placed = lambda xs: _let(reach(xs), lambda r: F.transform(xs, lambda x, i: F.struct(x["s"].alias("s"), F.when(i == 0, 0).otherwise(F.get(r, i - 1)).alias("at"), F.get(r, i).alias("to"))))
    fresh = lambda xs: F.filter(placed(xs), lambda x: (x["s"] > x["at"]) | (x["at"] == 0))

    def block(xs: Column) -> Column:
        low = F.get(xs, F.lit(0))["at"]
        cut = F.substr(text, low + 1, F.try_element_at(xs, F.lit(-1))["s"] - low)
        return _let(cut, lambda c: F.array_join(F.transform(xs, lambda x: F.concat(F.substr(c, x["at"] - low + 1, x["s"] - x["at"]), F.lit("[SECRET]"))), ""))

    end = F.aggregate(spans, F.lit(0), lambda acc, x: F.greatest(acc, x["e"]))
    return F.concat(_let(fresh(spans), lambda xs: F.array_join(_in_blocks(xs, block), "")), F.substr(text, end + 1))


def redact(docs: DataFrame, text: str = "text") -> DataFrame:
    """``docs`` with every secret span of ``text`` replaced by ``[SECRET]``; spans that overlap or touch are one.

    Rows without a span, null texts among them, keep their text unchanged.
    """
    out = scan(docs.select(F.struct(*docs.columns).alias("doc"), F.col(text).alias("text")), "text")
    spans, text_of = F.col("secret_spans"), F.col("text")
    clean = _let(F.struct(text_of.alias("t"), spans.alias("xs")), lambda x: _masked(x["t"], x["xs"]))
    return out.select(F.col("doc").withField(text, F.when(F.size(spans) > 0, clean).otherwise(text_of)).alias("doc")).select("doc.*")


def _joined(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda x: F.concat_ws(":", x["kind"], x["s"], x["e"])), ",")


def op5_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = scan(documents(spark, sf_dir).select("doc_id", "text")).select("doc_id", "secret_spans")
    spans = F.col("secret_spans")
    count = lambda kind: F.size(F.filter(spans, lambda x: x["kind"] == kind)).cast("long")
    return found.select(
        "doc_id",
        count("assign").alias("n_assign"),
        count("access").alias("n_access"),
        count("hex").alias("n_hex"),
        F.sha2(_joined(F.filter(spans, lambda x: x["kind"] != "entropy")), 256).alias("base_sha256"),
        _joined(spans).alias("spans"),
        count("entropy").alias("n_entropy"),
    )


def _quoted(pattern: str) -> str:
    return "'" + pattern.replace("'", "''") + "'"


def _sql(docs: str = "documents") -> str:
    """The same rows in DuckDB.  Candidates are islands of characters of the alphabet that no assign span covers; entropies are counted window by window."""
    kinds = [("assign", 0, ASSIGN), ("access", 1, ACCESS), ("hex", 2, HEX)]
    each = " union all ".join(
        f"select r, '{kind}' kind, {k} k, regexp_extract_all(x, {_quoted(p)}) ms, string_split_regex(x, {_quoted(p)}) ps from t" for kind, k, p in kinds
    )
    window = f"list_max([list_entropy(string_split(m[i:i + {WINDOW - 1}], '')) for i in range(1, length(m) - {WINDOW - 2})])"
    verdict = " ".join(f"when regexp_matches(m, {_quoted(p)}) then {window} >= {bits - ROUNDING!r}e0" for p, _, bits in CLASSES.values())
    # RE2 has no back references; a repeated character has no entropy anyway.
    allowed = " or ".join(f"regexp_matches(m, {_quoted(p)})" for p in (*ALLOWED, f"^(?:{ACCESS})$", f"^(?:{HEX})$") if "\\1" not in p)
    columns = ", ".join(f"count(case when kind = '{k}' then 1 end) n_{k}" for k in ("assign", "access", "hex", "entropy"))
    joined = "array_to_string(list(concat(kind, ':', s, ':', e) order by s, k){}, ',')"
    return f"""
with t as (select doc_id, coalesce(text, '') x, row_number() over () r from {docs}),
found as ({each}),
places as (select r, kind, k, unnest([{{'m': ms[i], 's': list_sum([length(p) for p in ps[1:i]]) + coalesce(list_sum([length(p) for p in ms[1:i - 1]]), 0)}} for i in range(1, len(ms) + 1)]) q from found),
spans as (select r, kind, k, q.m m, cast(q.s as int) s, cast(q.s as int) + length(q.m) e from places),
base as (select * from spans where kind in ('access', 'hex') or kind = 'assign' and length(regexp_extract(m, {_quoted(ASSIGN)}, 1)) >= 12),
busy as (select r, unnest(range(s, e)) i from base where kind = 'assign'),
hopeful as (select r, x from t where regexp_matches(x, {_quoted(CANDIDATE)})),
letters as (select r, x[i + 1] c, i from (select r, x, cast(unnest(range(0, length(x))) as int) i from hopeful)),
live as (select l.r, l.i, c, l.i - row_number() over (partition by l.r order by l.i) island from letters l anti join busy b on l.r = b.r and l.i = b.i where regexp_matches(c, '^[A-Za-z0-9+/_=-]$')),
candidates as (select r, cast(min(i) as int) s, cast(max(i) + 1 as int) e, string_agg(c, '' order by i) m from live group by r, island having count(*) >= {WINDOW}),
extra as (select r, 'entropy' kind, 3 k, m, s, e from candidates where not ({allowed}) and case {verdict} else false end),
everything as (select r, kind, k, s, e from base union all select r, kind, k, s, e from extra),
grouped as (select r, {columns}, {joined.format(" filter (kind <> 'entropy')")} b, {joined.format("")} spans from everything group by r)
select t.doc_id, coalesce(n_assign, 0) n_assign, coalesce(n_access, 0) n_access, coalesce(n_hex, 0) n_hex, sha256(coalesce(b, '')) base_sha256, coalesce(spans, '') spans, coalesce(n_entropy, 0) n_entropy
from t left join grouped g on g.r = t.r"""


QUERIES = {"op5_secrets": op5_secrets}
ORACLES = {"op5_secrets": _sql()}

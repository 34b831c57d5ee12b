"""Chunks of texts (byte windows, Markdown sections), hashes of bytes and grams, mentions and header lines."""

from __future__ import annotations

import hashlib
import re

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

from palimpsest.catalog import Entry
from palimpsest.sources.tables import table

# Folders and endings by which a mention is taken for a path.
PATH_ROOTS = ["crates/", "src/", "docs/", "bin/", "tests/", ".rulebook/", ".claude/", "scripts/", "gui/", "packages/"]
PATH_ENDS = ["rs", "ts", "tsx", "js", "jsx", "py", "go", "java", "cs", "cpp", "c", "h", "hpp", "md", "toml", "json", "yaml", "yml", "html", "css", "sh", "sql", "tml", "lock"]
_PATH = "^(?:" + "|".join(re.escape(r) for r in PATH_ROOTS) + r")|^[^:]*\.(?:" + "|".join(PATH_ENDS) + r")(?::.*)?$|\.(?:" + "|".join(PATH_ENDS) + ")$"
_SESSION = r"(?i:session)[:\s]*([0-9A-Z]{26})"
_LINK = r"\[[^\[\]]*\]\(([^)]*)\)"
_CODE = "`([^`]+)`"
_DECISION = "DEC-[0-9]{3,}"


def byte_spans(data: bytes, size: int, stride: int):
    """(start, end) of overlapping windows of at most ``size`` bytes that cut no character; the last ends the text."""
    snap = lambda i: next(j for j in range(i, i - 4, -1) if j == len(data) or data[j] & 0xC0 != 0x80)
    start = 0
    while start < len(data):
        end = snap(min(start + size, len(data)))
        yield start, end
        if end == len(data):
            return
        start = snap(start + stride)


def rows_of_texts(df: DataFrame, key: str, col: str, fields: list[tuple[str, str]], make) -> DataFrame:
    """(key, *fields): ``make(text)`` gives the rows of each text, null being empty. Keys pass through Arrow as they are,
    so that a large id beside a null stays what it is."""
    schema = T.StructType([df.schema[key], *(T.StructField(n, T.StructType.fromDDL(f"x {t}")[0].dataType) for n, t in fields)])
    kinds = [to_arrow_type(f.dataType) for f in schema]

    def batch(rows: list[tuple]) -> pa.RecordBatch:
        columns = zip(*rows) if rows else [[]] * len(kinds)
        return pa.RecordBatch.from_arrays([pa.array(list(v), type=t) for v, t in zip(columns, kinds)], names=schema.names)

    def run(batches):
        for b in batches:
            rows = []
            for k, text in zip(b.column(key).to_pylist(), b.column(col).to_pylist()):
                for row in make(text or ""):
                    rows.append((k, *row))
                    if len(rows) == 4096:
                        yield batch(rows)
                        rows = []
            yield batch(rows)

    return df.select(key, col).mapInArrow(run, schema)


def byte_windows(df: DataFrame, key: str, col: str, size: int = 2048, stride: int = 512) -> DataFrame:
    """(key, n, first_byte, end_byte, window) of each text; null and empty texts have no windows."""

    def windows(text: str):
        data = text.encode()
        for n, (a, b) in enumerate(byte_spans(data, size, stride)):
            yield n, a, b, data[a:b].decode()

    return rows_of_texts(df, key, col, [("n", "long"), ("first_byte", "long"), ("end_byte", "long"), ("window", "string")], windows)


_HEADING = re.compile(r"(#{1,3})[ \t]+(\S.*)")
_FENCE = re.compile(r"\s*(```|~~~)\s*(\S*)")


def sections(text: str, least: int = 256, long_fence: int = 40):
    """(kind, path, body) of a Markdown text: its sections under headings of three levels, then its long code blocks.

    Code blocks of more than ``long_fence`` lines leave a mark in their section. A section with fewer than ``least``
    characters below its heading joins the next one, the last such the one before.
    """
    found, codes, path, fence, block = [], [], [], None, []
    here = ["", "", ""]  # path, all lines, lines below the heading

    def close_block(closing: str):
        nonlocal block
        if len(block) - 1 > long_fence:
            codes.append(("code", fence[1], "".join(block[1:])))
            kept = f"[[code-block:{here[1].count('[[code-block:')}]]\n"
        else:
            kept = "".join(block) + closing
        here[1], here[2], block = here[1] + kept, here[2] + kept, []

    for line in re.findall(r"[^\n]*\n|[^\n]+", text):
        mark = _FENCE.match(line)
        if fence is not None:
            if mark and mark[1] == fence[0]:
                close_block(line)
                fence = None
            else:
                block.append(line)
            continue
        if mark:
            fence, block = (mark[1], mark[2]), [line]
            continue
        heading = _HEADING.match(line)
        if heading:
            found.append(here)
            path = path[: len(heading[1]) - 1] + [heading[2].strip()]
            here = [" > ".join(path), line, ""]
        else:
            here[1], here[2] = here[1] + line, here[2] + line
    if fence is not None:
        close_block("")
    found.append(here)

    merged, waiting = [], ""
    for name, whole, below in found:
        if len(below.strip()) < least:
            waiting += whole
        else:
            merged.append(["section", name, waiting + whole])
            waiting = ""
    if waiting and merged:
        merged[-1][2] += waiting
    elif waiting:
        merged.append(["section", found[0][0] or (found[1][0] if len(found) > 1 else ""), waiting])
    yield from (tuple(m) for m in merged if m[2].strip())
    yield from codes


def markdown_chunks(df: DataFrame, key: str, col: str) -> DataFrame:
    """(key, n, kind, path, body) of each text, in order; null and blank texts have none."""
    numbered = lambda text: ((n, *row) for n, row in enumerate(sections(text)))
    return rows_of_texts(df, key, col, [("n", "long"), ("kind", "string"), ("path", "string"), ("body", "string")], numbered)


def octets(c: Column) -> Column:
    """The bytes of a text as numbers."""
    data = F.encode(c, "utf-8")
    each = F.transform(F.sequence(F.lit(1), F.octet_length(data)), lambda i: F.conv(F.hex(F.substring(data, i, F.lit(1))), 16, 10).cast("long"))
    return F.when(F.octet_length(data) == 0, F.array().cast("array<bigint>")).otherwise(each)


def fnv1a_64(c: Column) -> Column:
    """64-bit FNV-1a of a text's bytes, as 16 hexadecimal digits.

    The prime is 2**40 + 435, so that two halves of 32 bits need no arithmetic beyond 64 bits.
    """
    start = F.struct(F.lit(0xCBF29CE4).cast("long").alias("hi"), F.lit(0x84222325).cast("long").alias("lo"))
    low = F.lit(0xFFFFFFFF).cast("long")

    def step(h, b):
        lo = h["lo"].bitwiseXOR(b)
        hi = h["hi"] * 435 + F.shiftright(lo * 435, 32) + F.shiftleft(lo, 8)
        return F.struct(hi.bitwiseAND(low).alias("hi"), (lo * 435).bitwiseAND(low).alias("lo"))

    digits = lambda x: F.lpad(F.lower(F.hex(x)), 8, "0")
    return F.aggregate(octets(c), start, step, lambda h: F.concat(digits(h["hi"]), digits(h["lo"])))


def gram_bins(c: Column) -> Column:
    """For each window of four bytes (of the text with ASCII letters in lower case) its FNV-1a hash modulo 256.

    The last eight bits of a product depend on the last eight bits of its factors alone.
    """
    low = F.translate(c, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")

    def bins(b):
        def at(i):
            h = F.lit(0x25).cast("long")
            for j in range(4):
                h = (h.bitwiseXOR(F.element_at(b, i + j)) * 0xB3).bitwiseAND(F.lit(255).cast("long"))
            return h

        return F.when(F.size(b) >= 4, F.transform(F.sequence(F.lit(1), F.size(b) - 3), at))

    return F.get(F.transform(F.array(octets(low)), bins), F.lit(0))  # a variable, lest the bytes be read anew for every gram


def gram_vectors(df: DataFrame, key: str, col: str) -> DataFrame:
    """(key, bin, weight): the unit vector of hashed four-byte grams in 256 bins; shorter texts have bin 0 alone."""
    bins = df.select(key, F.explode(F.coalesce(gram_bins(F.col(col)), F.array(F.lit(0).cast("long")))).alias("bin"))
    counts = bins.groupBy(key, "bin").agg(F.count("*").alias("n"))
    norms = counts.groupBy(key).agg(F.sqrt(F.sum(F.col("n") * F.col("n"))).alias("norm"))
    return counts.join(norms, key).select(key, "bin", (F.col("n") / F.col("norm")).alias("weight"))


def mentions(c: Column) -> Column:
    """(kind, found) of the session ids, file paths and decision ids that a text names."""
    both = F.concat(F.regexp_extract_all(c, F.lit(_LINK), 1), F.regexp_extract_all(c, F.lit(_CODE), 1))
    paths = F.filter(F.transform(both, lambda p: F.trim(p)), lambda p: p.contains("/") & ~p.rlike(r"^http|[ \n]") & (F.octet_length(p) <= 256) & p.rlike(_PATH))
    named = lambda kind, xs: F.transform(xs, lambda x: F.struct(F.lit(kind).alias("kind"), x.alias("found")))
    found = F.concat(named("session", F.regexp_extract_all(c, F.lit(_SESSION), 1)), named("path", paths), named("decision", F.regexp_extract_all(c, F.lit(_DECISION), 0)))
    return F.array_distinct(found)


def header(c: Column, name: str, lines: int) -> Column:
    """What the first of a text's first ``lines`` lines that starts with ``name:`` has after it; null without one."""
    bare = F.transform(F.slice(F.split(c, "\n"), 1, lines), lambda x: F.regexp_replace(x, r"^\s+|\s+$", ""))
    kept = F.filter(bare, lambda x: x.rlike(f"(?i)^{name}:\\s*\\S"))
    return F.regexp_replace(F.get(kept, F.lit(0)), f"(?i)^{name}:\\s*", "")


def topic_card_id(slug: Column, repo: Column) -> Column:
    return F.concat(F.lit("topic-"), F.substring(F.sha2(F.concat(slug, F.lit("\0"), repo), 256), 1, 24))


def c01(spark, sf_dir):
    return table(spark, sf_dir, "benchmark").select("item_id", fnv1a_64(F.col("text")).alias("hash"))


def c02(spark, sf_dir):
    v = gram_vectors(table(spark, sf_dir, "benchmark"), "item_id", "text")
    return v.select("item_id", "bin", F.round("weight", 9).alias("weight"))


def c19(spark, sf_dir):
    d = table(spark, sf_dir, "documents")
    return d.groupBy(topic_card_id(F.col("lang"), F.col("source")).alias("card")).agg(F.count("*").alias("n"))


def c21(spark, sf_dir):
    """Notes about every document, with a session, two paths, one address and a decision."""
    d, t = table(spark, sf_dir, "documents"), F.lit
    note = F.concat(t("Session: "), F.upper(F.substring(F.md5("text"), 1, 26)), t(" see ["), F.col("source"), t("](docs/"), F.col("lang"), t("/"), F.col("doc_id"), t(") and `"), F.col("lang"), t("/part"), F.col("doc_id"), t(".py:12` or `http://x/a.md`, DEC-"), F.col("doc_id"))
    return d.select("doc_id", F.explode(mentions(note)).alias("m")).select("doc_id", "m.kind", "m.found")


def c22(spark, sf_dir):
    """Every document's text below its own number of empty lines and two header lines."""
    d = table(spark, sf_dir, "documents")
    text = F.concat(F.repeat(F.lit("\n"), (F.col("n_chars") % 80).cast("int")), F.lit("Status:  "), F.upper("lang"), F.lit("\n Supersedes: DEC-"), F.col("doc_id"), F.lit(" now\n"), F.col("text"))
    status = F.coalesce(F.lower(header(text, "status", 32)), F.lit("active"))
    return d.select("doc_id", status.alias("status"), F.regexp_extract(header(text, "supersedes", 64), r"^\S+", 0).alias("supersedes"))


def h01(spark, sf_dir):
    w = byte_windows(table(spark, sf_dir, "documents"), "doc_id", "text")
    return w.select("doc_id", "n", "first_byte", "end_byte", F.md5("window").alias("hash"))


def h02(spark, sf_dir):
    """Documents as Markdown: short lines head what follows."""
    d = table(spark, sf_dir, "documents").select("doc_id", F.regexp_replace("text", r"(?m)^([^\n#]{1,60})$", "## $1").alias("text"))
    return markdown_chunks(d, "doc_id", "text").select("doc_id", "n", "kind", "path", F.md5("body").alias("hash"))


def _duck(pattern: str) -> str:
    return pattern.replace("'", "''")


# The bytes of a text are read from its hexadecimal form.
_BYTES = "list_transform(range(0, octet_length(encode({0}))), lambda i: ('0x' || substr(hex(encode({0})), 2*i+1, 2))::bigint)"
_BIN = "cast(37 as bigint)"
for _j in range(4):
    _BIN = f"((xor({_BIN}, b[i+{_j}])*179) & 255)"
_CUT = "case {0} when {1} then {1} else {0} - case when substr(h,2*({0})+1,1) not in ('8','9','A','B') then 0 when substr(h,2*({0})-1,1) not in ('8','9','A','B') then 1 when substr(h,2*({0})-3,1) not in ('8','9','A','B') then 2 else 3 end end"
_NOTE = "'Session: ' || upper(substr(md5(text),1,26)) || ' see [' || source || '](docs/' || lang || '/' || doc_id || ') and `' || lang || '/part' || doc_id || '.py:12` or `http://x/a.md`, DEC-' || doc_id"
ENTRIES = {
    "C01_fnv": Entry(c01, f"with b as (select item_id, {_BYTES.format('text')} b from benchmark), h as (select item_id, list_reduce(list_prepend(14695981039346656037::hugeint, list_transform(b, lambda x: x::hugeint)), lambda h, x: (xor(h,x)*1099511628211::hugeint) % 18446744073709551616::hugeint) h from b) select item_id, lower(lpad(to_hex(cast(h // 4294967296 as bigint)),8,'0') || lpad(to_hex(cast(h % 4294967296 as bigint)),8,'0')) hash from h"),
    "C02_grams": Entry(c02, f"with b as (select item_id, {_BYTES.format('translate(text,' + chr(39) + 'ABCDEFGHIJKLMNOPQRSTUVWXYZ' + chr(39) + ',' + chr(39) + 'abcdefghijklmnopqrstuvwxyz' + chr(39) + ')')} b from benchmark), g as (select item_id, unnest(case when len(b)<4 then [0] else list_transform(range(1, len(b)-2), lambda i: {_BIN}) end) bin from b), n as (select item_id, bin, count(*) n from g group by 1,2) select item_id, bin, round(n/sqrt(sum(n*n) over (partition by item_id)),9) weight from n"),
    "C19_topic_cards": Entry(c19, "select 'topic-' || substr(sha256(encode(lang) || '\\x00'::blob || encode(source)),1,24) card, count(*) n from documents group by 1"),
    "C21_mentions": Entry(c21, f"with d as (select doc_id, {_NOTE} note from documents), p as (select doc_id, unnest(list_concat(regexp_extract_all(note,'{_duck(_LINK)}',1),regexp_extract_all(note,'{_CODE}',1))) found from d) select distinct doc_id, 'session' kind, unnest(regexp_extract_all(note,'{_duck(_SESSION)}',1)) found from d union all select distinct doc_id, 'decision', unnest(regexp_extract_all(note,'{_DECISION}')) from d union all select distinct doc_id, 'path', trim(found) from p where contains(found,'/') and not starts_with(found,'http') and not regexp_matches(found,'[ \\n]') and (regexp_matches(found,'^(docs|src)/') or regexp_matches(split_part(found,':',1),'[.](py|md)$'))"),
    "C22_headers": Entry(c22, "select doc_id, case when n_chars%80<32 then lower(lang) else 'active' end status, case when n_chars%80+1<64 then 'DEC-' || doc_id end supersedes from documents where text is not null"),
    "H01_windows": Entry(h01, f"with recursive d as (select doc_id, hex(encode(text)) h, octet_length(encode(text)) l from documents where text<>''), w as (select doc_id, h, l, cast(0 as bigint) n, cast(0 as bigint) a from d union all select doc_id, h, l, n+1, {_CUT.format('(a+512)', 'l')} from w where ({_CUT.format('least(a+2048,l)', 'l')})<l) select doc_id, n, a first_byte, {_CUT.format('least(a+2048,l)', 'l')} end_byte, md5(unhex(substr(h,2*a+1,2*({_CUT.format('least(a+2048,l)', 'l')}-a)))) hash from w"),
    "H02_sections": Entry(h02),
}

"""DuckDB SQL of the catalog's queries, written independently of the Spark plans where that is cheap."""

from __future__ import annotations

# Fixed values, written again here so that the SQL doesn't take them from the code that it checks.
_SCALES = (1.0, 0.2, 0.2, 1.0, 1.0)
_STACK_NAMES = ("sp", "rsp", "esp", "rbp", "ebp", "$sp", "r11", "fp", "x29")
_MNEMONIC_TESTS = [
    ("CALL", "IN ('call', 'bl', 'blr', 'jal', 'jalr', 'bal')"),
    ("RET", "IN ('ret', 'retn', 'eret', 'bx', 'jr')"),
    ("SYSCALL", "IN ('syscall', 'svc', 'swi', 'int')"),
    ("MOVE", "IN ('mov', 'move', 'movz', 'movn', 'lea', 'li', 'la', 'adr', 'adrp', 'csel')"),
    ("LOAD", "^(ldr|ld|lw|lh|lb|lbu|lhu|ldu|movsx|movzx)"),
    ("STORE", "^(str|st|sw|sh|sb)"),
    ("ARITH", "^(add|sub|mul|imul|div|idiv|madd|msub|neg|inc|dec)"),
    ("LOGIC", "^(and|orr|or|xor|eor|not|bic|nor)"),
    ("SHIFT", "^(shl|shr|sar|sal|sll|srl|sra|lsl|lsr|asr|ror|rol)"),
    ("CMP", "^(cmp|cmn|test|tst|slt|slti)"),
    ("BRANCH_UNCOND", "IN ('jmp', 'j', 'b', 'br', 'bra')"),
    ("BRANCH_COND", "^(je|jne|jz|jnz|ja|jae|jb|jbe|jg|jge|jl|jle|jo|jno|js|jns|jp|jnp|beq|bne|bgt|bge|blt|ble|bhi|bls|bcs|bcc|cbz|cbnz|tbz|tbnz)"),
    ("STACK", "^(push|pop)"),
    ("STACK", "IN ('enter', 'leave', 'stp', 'ldp')"),
]

FX = """fx AS (
 SELECT concat('rel-1.', CAST(year(o_orderdate) - 1965 AS VARCHAR), '.0') AS version, o_orderpriority AS arch,
  concat(CAST(l_orderkey AS VARCHAR),'-',CAST(l_linenumber AS VARCHAR),'-',CAST(l_partkey AS VARCHAR),'-',CAST(l_suppkey AS VARCHAR),'-',CAST(CAST(l_quantity AS INT) AS VARCHAR)) AS function_id,
  CAST(l_orderkey * 8 + l_linenumber AS BIGINT) AS address, CAST(floor((p_retailprice - 880) * (1 + l_quantity)) AS BIGINT) AS size,
  concat('fn_', CAST(l_partkey AS VARCHAR), CASE l_linenumber % 4 WHEN 1 THEN '.part.0' WHEN 2 THEN '.constprop.1.isra.0' WHEN 3 THEN '@GLIBC_2.4' ELSE '' END) AS name,
  concat('fn_', CAST(l_partkey AS VARCHAR)) AS norm_name, l_partkey, l_suppkey, l_orderkey, l_linenumber, CAST(l_quantity AS INT) AS quantity
 FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN part ON l_partkey = p_partkey)"""
LAB = "lab AS (SELECT * FROM fx WHERE l_partkey % 10 <> 0)"
STR = "strip AS (SELECT * REPLACE (size + l_suppkey % 3 AS size) FROM fx WHERE l_orderkey % 7 <> 0)"
DOCS = """docs AS (
 SELECT concat('doc-', CAST(doc_id AS VARCHAR)) AS function_id,
  list_filter(regexp_split_to_array(lower(text), '[ \\t\\n\\r\\f]+'), lambda w: w <> '') AS tokens FROM documents)"""
VEC = """vec AS (
 SELECT concat('rel-1.', CAST(30 + vec_id % 7 AS VARCHAR), '.0') AS version, concat('a', CAST((vec_id // 7) % 5 AS VARCHAR)) AS arch, vec_id,
  concat('fn_', CAST(label AS VARCHAR)) AS norm_name, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS v FROM embeddings)"""
LONG = "long AS (SELECT version, arch, vec_id, norm_name, unnest(range(len(v))) AS dim, unnest(v) AS x FROM vec)"


_SHAPE = ("log_size", "addr_pos", "order_pos", "local_mean", "local_diff")


def shaped(name: str, source: str) -> str:
    return f"""{name}0 AS (
 SELECT *, ln(1.0::DOUBLE + size) AS log_size,
  CAST(address - min(address) OVER p AS DOUBLE) / greatest(max(address + size) OVER p - min(address) OVER p, 1) AS addr_pos,
  CAST(row_number() OVER o - 1 AS DOUBLE) / greatest(count(*) OVER p - 1, 1) AS order_pos
 FROM {source} WINDOW p AS (PARTITION BY version, arch), o AS (PARTITION BY version, arch ORDER BY address, size, norm_name, function_id)),
{name} AS (
 SELECT *, log_size - local_mean AS local_diff FROM (
  SELECT *, avg(log_size) OVER (PARTITION BY version, arch ORDER BY address, size, norm_name, function_id ROWS BETWEEN 2 PRECEDING AND 2 FOLLOWING) AS local_mean FROM {name}0))"""


def mnemonic_case(word: str) -> str:
    m = f"split_part(lower(trim({word})), '.', 1)"
    out = f"CASE WHEN trim({word}) = '' THEN 'OTHER'"
    for name, listed in _MNEMONIC_TESTS:
        test = f"{m} {listed}" if listed.startswith("IN") else f"regexp_matches({m}, '{listed}')"
        out += f" WHEN {test} THEN '{name}'"
    return out + " ELSE 'OTHER' END"


def bucket_case(v: str) -> str:
    return f"CASE WHEN {v} = 0 THEN 'IMM_ZERO' WHEN {v} = 1 THEN 'IMM_ONE' WHEN {v} < 0 THEN 'IMM_NEG' WHEN {v} <= 255 THEN 'IMM_SMALL' WHEN {v} <= 65535 THEN 'IMM_MEDIUM' WHEN {v} & ({v} - 1) = 0 THEN 'IMM_MASK' ELSE 'IMM_LARGE' END"


def category_case(s: str) -> str:
    return f"""concat(CASE WHEN regexp_full_match({s}, '[0-9]+') THEN 'numeric' WHEN contains(lower({s}), '://') OR starts_with(lower({s}), 'www.') THEN 'url_like' WHEN contains({s}, '/') OR contains({s}, chr(92)) THEN 'path_like' WHEN starts_with({s}, '-') THEN 'option_like' WHEN contains({s}, '%') THEN 'format_like' WHEN regexp_matches(lower({s}), 'error|failed|invalid|usage') THEN 'message_like' ELSE 'other' END, ':', CASE WHEN length({s}) <= 8 THEN 'len_0_8' WHEN length({s}) <= 32 THEN 'len_9_32' WHEN length({s}) <= 128 THEN 'len_33_128' ELSE 'len_129_plus' END)"""


KEY3 = "list_transform(string_split(replace(version, 'rel-', ''), '.'), lambda p: CAST(p AS INT))"
RANGE_LABEL = f"CASE WHEN {KEY3} >= [1,16,0] AND {KEY3} <= [1,33,1] THEN 1 WHEN {KEY3} >= [1,34,0] THEN 0 END"
SPLIT = f"CASE WHEN {KEY3} <= [1,30,1] THEN 'train' WHEN {KEY3} >= [1,31,0] AND {KEY3} <= [1,33,2] THEN 'validation' WHEN {KEY3} >= [1,34,0] THEN 'test' END"

PAIRS = "bins AS (SELECT DISTINCT version, arch FROM fx), pairs AS (SELECT a.version, a.arch AS src_arch, c.arch AS dst_arch FROM bins a JOIN bins c ON a.version = c.version AND a.arch <> c.arch)"


def relevant(source: str) -> str:
    return f"rq AS (SELECT f.*, p.src_arch, p.dst_arch FROM {source} f JOIN pairs p ON f.version = p.version AND f.arch = p.src_arch WHERE EXISTS (SELECT 1 FROM {source} c WHERE c.version = f.version AND c.arch = p.dst_arch AND c.norm_name = f.norm_name))"


def sampled(most: int) -> str:
    return f"""rn AS (SELECT *, row_number() OVER (PARTITION BY version, src_arch, dst_arch ORDER BY address, size, norm_name, function_id) - 1 AS r, count(*) OVER (PARTITION BY version, src_arch, dst_arch) AS n FROM rq),
picks AS (SELECT DISTINCT n, CAST(floor(CAST(i AS DOUBLE) * (CAST(n AS DOUBLE) / {most}.0::DOUBLE)) AS BIGINT) AS r FROM (SELECT DISTINCT n FROM rn WHERE n > {most}), range({most}) t(i)),
q AS (SELECT * FROM rn WHERE n <= {most} OR EXISTS (SELECT 1 FROM picks WHERE picks.n = rn.n AND picks.r = rn.r))"""


ALL_QUERIES = "q AS (SELECT * FROM rq)"
BY_SIZE = """ci AS (SELECT version, arch, size, norm_name, function_id, row_number() OVER (PARTITION BY version, arch ORDER BY size, norm_name, address, function_id) - 1 AS idx FROM fx),
starts AS (SELECT version, arch, size, min(idx) AS pos FROM ci GROUP BY ALL),
cn AS (SELECT version, arch, count(*) AS candidates FROM ci GROUP BY ALL),
qp AS (SELECT q.version, q.src_arch, q.dst_arch, q.function_id, q.norm_name, q.size, coalesce(s.pos, cn.candidates) AS pos
 FROM q JOIN cn ON cn.version = q.version AND cn.arch = q.dst_arch ASOF LEFT JOIN starts s ON s.version = q.version AND s.arch = q.dst_arch AND s.size >= q.size),
near AS (SELECT qp.*, c.size AS c_size, c.norm_name AS c_name, c.idx, abs(c.size - qp.size) AS distance, c.idx < qp.pos AS is_left
 FROM qp JOIN ci c ON c.version = qp.version AND c.arch = qp.dst_arch AND c.idx BETWEEN qp.pos - 10 AND qp.pos + 9),
taken AS (SELECT * FROM near QUALIFY row_number() OVER (PARTITION BY version, src_arch, dst_arch, function_id ORDER BY distance, is_left DESC, CASE WHEN is_left THEN -idx ELSE idx END) <= 10),
ranked AS (SELECT *, row_number() OVER (PARTITION BY version, src_arch, dst_arch, function_id ORDER BY distance, idx) AS rnk FROM taken)"""
METRICS = """firsts AS (SELECT version, src_arch, dst_arch, function_id, min(rnk) AS first FROM ranked WHERE c_name = norm_name GROUP BY ALL),
m AS (SELECT q.version, q.src_arch, q.dst_arch, count(*) AS queries, avg(CASE WHEN first <= 1 THEN 1.0::DOUBLE ELSE 0 END) AS hit_at_1, avg(CASE WHEN first <= 5 THEN 1.0::DOUBLE ELSE 0 END) AS hit_at_5,
 avg(CASE WHEN first <= 10 THEN 1.0::DOUBLE ELSE 0 END) AS hit_at_10, avg(coalesce(1.0::DOUBLE / first, 0)) AS mrr_at_10, avg(CAST(coalesce(first, 11) AS DOUBLE)) AS mean_inspected_at_10
 FROM q LEFT JOIN firsts USING (version, src_arch, dst_arch, function_id) GROUP BY ALL)"""
SIZE_PAIRS = f"WITH {FX}, {PAIRS}, {relevant('fx')}, {ALL_QUERIES}, {BY_SIZE}, {METRICS}"
RANDOM = """names AS (SELECT version, arch AS dst_arch, norm_name, count(*) AS relevant FROM fx GROUP BY ALL), szs AS (SELECT version, arch AS dst_arch, count(*) AS candidates FROM fx GROUP BY ALL),
rnd AS (SELECT rq.version, src_arch, rq.dst_arch, count(*) AS queries, avg(least(1.0::DOUBLE, 1.0::DOUBLE * relevant / candidates)) AS h1, avg(least(1.0::DOUBLE, 5.0::DOUBLE * relevant / candidates)) AS h5, avg(least(1.0::DOUBLE, 10.0::DOUBLE * relevant / candidates)) AS h10
 FROM rq JOIN names n ON n.version = rq.version AND n.dst_arch = rq.dst_arch AND n.norm_name = rq.norm_name JOIN szs s ON s.version = rq.version AND s.dst_arch = rq.dst_arch GROUP BY ALL)"""
_M = ("hit_at_1", "hit_at_5", "hit_at_10", "mrr_at_10", "mean_inspected_at_10")
_M9 = ", ".join(f"round({m}, 9) AS {m}" for m in _M)
AGGS = ", ".join(f"round(avg(round({m}, 6)), 8) AS macro_{m}, round(sum(round({m}, 6) * queries) / greatest(sum(queries), 1), 8) AS weighted_{m}" for m in _M)
SMAP = "smap AS (SELECT version, arch, norm_name, max(size) AS size FROM fx GROUP BY ALL)"
STEPS = "steps AS (SELECT * FROM (SELECT arch, version AS old, lead(version) OVER (PARTITION BY arch ORDER BY version) AS new FROM (SELECT DISTINCT arch, version FROM smap)) WHERE new IS NOT NULL)"
CHANGE = f"WITH {FX}, {SMAP}, {STEPS}, ch AS (SELECT a.arch, old, new, a.norm_name, a.size AS old_size, c.size AS new_size, abs(c.size - a.size) AS abs_change, abs(c.size - a.size)::DOUBLE / greatest(a.size, c.size, 1) AS rel_change FROM steps s JOIN smap a ON a.arch = s.arch AND a.version = s.old JOIN smap c ON c.arch = s.arch AND c.version = s.new AND c.norm_name = a.norm_name)"
STATS = "st AS (SELECT version, arch, count(*) AS functions, avg(size) AS mean, quantile_cont(size, 0.5) AS median, quantile_cont(size, 0.9) AS p90, quantile_cont(size, 0.99) AS p99 FROM fx GROUP BY ALL)"
TF = f"WITH {DOCS}, occ AS (SELECT function_id, len(tokens) AS total, unnest(tokens) AS token, len(tokens) AS cut FROM docs), cnt AS (SELECT function_id, token, cut AS total, count(*) AS n FROM occ GROUP BY ALL), nd AS (SELECT count(*) AS nd FROM docs), df AS (SELECT token, count(*) AS df, ln((1.0::DOUBLE + any_value(nd.nd)) / (1.0::DOUBLE + count(*))) + 1.0::DOUBLE AS idf FROM cnt, nd GROUP BY token), w AS (SELECT function_id, token, CAST(n AS DOUBLE) / total * idf AS weight FROM cnt JOIN df USING (token))"
PROTO = f"WITH {VEC}, {LONG}, own AS (SELECT version, norm_name, dim, sum(x) AS s, count(*) AS n FROM long GROUP BY ALL)"
LOVO = f"{PROTO}, pv AS (SELECT version AS test_version, norm_name, dim, (sum(s) OVER e - s) / (sum(n) OVER e - n) AS value, sum(n) OVER e - n AS tn FROM own WINDOW e AS (PARTITION BY norm_name, dim))"


def _centroid() -> str:
    f = ["functions", "mean", "median", "p90"]
    rows = " UNION ALL ".join(f"SELECT version, arch, label, '{x}' AS f, CAST({x} AS DOUBLE) AS x FROM lb" for x in f)
    return f"""WITH {FX}, {STATS}, lb AS (SELECT *, {RANGE_LABEL} AS label FROM st), l AS (SELECT * FROM ({rows}) WHERE label IS NOT NULL), held AS (SELECT DISTINCT arch AS held FROM lb),
tr AS (SELECT held, l.* FROM l, held WHERE arch <> held), te AS (SELECT held, l.* FROM l, held WHERE arch = held),
sc AS (SELECT held, f, avg(x) AS m, CASE WHEN stddev_pop(x) > 0 THEN stddev_pop(x) ELSE 1 END AS s FROM tr GROUP BY ALL),
ce AS (SELECT tr.held, tr.f, label AS guess, avg((x - m) / s) AS c FROM tr JOIN sc ON sc.held = tr.held AND sc.f = tr.f GROUP BY ALL),
ds AS (SELECT te.version, te.arch, te.label, guess, round(sum(((x - m) / s - c) ** 2), 9) AS d FROM te JOIN sc ON sc.held = te.held AND sc.f = te.f JOIN ce ON ce.held = te.held AND ce.f = te.f GROUP BY ALL),
pred AS (SELECT version, arch, label, guess AS predicted FROM ds QUALIFY row_number() OVER (PARTITION BY version, arch, label ORDER BY d, guess) = 1)"""


_STACK = " OR ".join(f"contains(t, '{r}')" for r in _STACK_NAMES)
# The scorers' values, written again here so that the SQL doesn't take them from the code it checks.
_METHODS = {
    "size_stat": "size_s",
    "shape_stat": "shape_s",
    "clap": "token_s",
    "issta_2024": "0.60::DOUBLE * token_s + 0.25::DOUBLE * shape_arch_s + 0.15::DOUBLE * context_s",
    "gtrans": "graph_s",
    "bar_2024": "0.40::DOUBLE * shape_arch_s + 0.35::DOUBLE * context_s + 0.25::DOUBLE * graph_arch_s",
    "ammf": "0.55::DOUBLE * token_s + 0.30::DOUBLE * graph_s + 0.15::DOUBLE * context_s",
    "cybersecurity_2025": "0.45::DOUBLE * fused_s + 0.20::DOUBLE * token_s + 0.20::DOUBLE * graph_arch_s + 0.15::DOUBLE * context_s",
    "binary2vec": "0.60::DOUBLE * fused_s + 0.20::DOUBLE * graph_arch_s + 0.20::DOUBLE * shape_arch_s",
    "vexir2vec_2023": "0.40::DOUBLE * graph_arch_s + 0.35::DOUBLE * token_s + 0.20::DOUBLE * shape_arch_s + 0.05::DOUBLE * context_s",
    "ex2vec_2025": "0.35::DOUBLE * token_s + 0.30::DOUBLE * graph_arch_s + 0.20::DOUBLE * context_s + 0.15::DOUBLE * shape_arch_s",
    "array_2025": "0.50::DOUBLE * fused_s + 0.25::DOUBLE * shape_arch_s + 0.25::DOUBLE * proto_s",
    "proto_shape": "0.70::DOUBLE * shape_s + 0.10::DOUBLE * fused_s + 0.20::DOUBLE * proto_s",
}
_CLASSES = "LOAD STORE ARITH LOGIC SHIFT CMP CALL RET BRANCH_COND BRANCH_UNCOND STACK MOVE SYSCALL OTHER".split()


def _hashed(column: str, prefix: str, dims: int) -> str:
    """{column}v: function_id and its list of dims hashed weights."""
    c = column
    return f"""{c}o AS (SELECT function_id, fitted, len({c}) AS total, unnest({c}) AS token FROM rec), {c}c AS (SELECT function_id, fitted, token, total, count(*) AS n FROM {c}o GROUP BY ALL),
{c}d AS (SELECT token, ln((1.0::DOUBLE + any_value(nf)) / (1.0::DOUBLE + count(*) FILTER (fitted))) + 1.0::DOUBLE AS idf FROM {c}c, nfit GROUP BY token),
{c}h AS (SELECT function_id, ('0x' || substr(md5('{prefix}' || token), 1, 8))::BIGINT AS h, n::DOUBLE / total * idf AS weight FROM {c}c JOIN {c}d USING (token)),
{c}s AS (SELECT function_id, h % {dims} AS slot, sum(CASE WHEN (h >> 8) & 1 = 1 THEN -weight ELSE weight END) AS value FROM {c}h GROUP BY ALL),
{c}v AS (SELECT r.function_id, list(coalesce(value, 0.0::DOUBLE) ORDER BY i) AS v FROM (SELECT function_id, unnest(range({dims})) AS i FROM rec) r LEFT JOIN {c}s s ON s.function_id = r.function_id AND s.slot = r.i GROUP BY r.function_id)"""


def _moments(name: str, column: str, by_arch: bool) -> str:
    arch, group = ("arch, ", "arch, i") if by_arch else ("", "i")
    return f"""{name} AS (SELECT {arch}list(mean ORDER BY i) AS mean, list(std ORDER BY i) AS std FROM (SELECT {arch}i, avg(x) AS mean, CASE WHEN var_pop(x) <= 1e-9 THEN 1.0::DOUBLE ELSE sqrt(var_pop(x)) END AS std
 FROM (SELECT arch, unnest({column}) AS x, unnest(range(len({column}))) AS i FROM base WHERE fitted) GROUP BY {group}){' GROUP BY arch' if by_arch else ''})"""


def _cosine(a: str, c: str) -> str:
    return f"CASE WHEN list_dot_product({a}, {a}) <= 1e-12 OR list_dot_product({c}, {c}) <= 1e-12 THEN 0.0::DOUBLE ELSE list_dot_product({a}, {c}) / sqrt(list_dot_product({a}, {a}) * list_dot_product({c}, {c})) END"


def records(fitted: str, matched: bool = False) -> str:
    """CTEs src to base: what the scorers' vectors are made of; matched: only of stripped functions that are mutual matches, with their label's name."""
    count = lambda test: f"count(*) FILTER ({test})"
    share = lambda x: f"list_transform({x}, lambda n: n::DOUBLE / greatest(list_sum({x}), 1))"
    return f"""src AS (SELECT concat('rel-1.', CAST(30 + CAST(regexp_extract(source, '([0-9]+)', 1) AS INT) % 7 AS VARCHAR), '.0') AS version, lang AS arch, concat('doc-', CAST(doc_id AS VARCHAR)) AS function_id,
 CAST(doc_id AS BIGINT) AS address, CAST(n_chars AS BIGINT) AS size, concat('fn_', CAST(doc_id % 40 AS VARCHAR)) AS norm_name, list_filter(regexp_split_to_array(lower(text), '[ \\t\\n\\r\\f]+'), lambda w: w <> '') AS tokens FROM documents),
{_matched_shapes() if matched else shaped('sh', 'src')}, rec AS (SELECT *, {fitted} AS fitted, {'' if matched else '1.0::DOUBLE AS confidence, '}list_transform(tokens, lambda t: concat('len_', CAST(least(length(t), 12) AS VARCHAR))) AS contexts FROM sh),
nfit AS (SELECT count(*) FILTER (fitted) AS nf FROM rec),
tk AS (SELECT function_id, op, n, word FROM (SELECT *, {mnemonic_case('word')} AS op, length(word) AS n FROM (SELECT function_id, unnest(tokens) AS word FROM rec))),
ct AS (SELECT function_id, count(*) AS ic, {count('n = 3')} AS bb, {count('n IN (3, 4)')} AS ed, {count("op = 'CALL'")} AS cc, {count("starts_with(op, 'BRANCH')")} AS bc, {count("op = 'RET'")} AS rc, {count('n > 8')} AS sc, {count("regexp_matches(word, '^[0-9]+$')")} AS kc,
 [{', '.join(count(f"op = '{k}'") for k in _CLASSES)}] AS ops, [{', '.join(count(f'n % 11 = {i}') for i in range(11))}] AS eds FROM tk GROUP BY function_id),
st AS (SELECT rec.*, coalesce(ic, 0) AS ic, coalesce(bb, 0) + 1 AS bb, coalesce(ed, 0) + 1 AS ed, coalesce(cc, 0) AS cc, coalesce(bc, 0) AS bc, coalesce(rc, 0) AS rc, coalesce(sc, 0) AS sc, coalesce(kc, 0) AS kc,
 coalesce(ops, list_transform(range(14), lambda i: 0)) AS ops, coalesce(eds, list_transform(range(11), lambda i: 0)) AS eds FROM rec LEFT JOIN ct USING (function_id)),
base AS (SELECT version, arch, function_id, norm_name, address, fitted, confidence, [log_size, addr_pos, order_pos, local_mean, local_diff] AS shp,
 list_concat([ln(1.0::DOUBLE + size), ln(1.0::DOUBLE + ic), ln(1.0::DOUBLE + bb), ln(1.0::DOUBLE + ed), cc::DOUBLE / greatest(ic, 1), bc::DOUBLE / greatest(ic, 1), rc::DOUBLE / greatest(ic, 1), sc::DOUBLE / greatest(ic, 1), kc::DOUBLE / greatest(ic, 1), ic::DOUBLE / bb, ed::DOUBLE / bb], list_concat({share('ops')}, {share('eds')})) AS raw FROM st)"""


def _matched_shapes() -> str:
    """CTEs up to sh: shapes of the stripped side whose functions are mutual matches with a label."""
    nine = ", ".join(f"round({c}, 9) AS {c}" for c in _SHAPE)
    return f"""mstrip AS (SELECT * REPLACE (size + address % 3 AS size) FROM src WHERE address % 7 <> 0), mlab AS (SELECT * FROM src WHERE address % 10 <> 0), {shaped('shs', 'mstrip')}, {shaped('shl', 'mlab')},
s AS (SELECT version, arch, function_id, address, norm_name, {nine} FROM shs), l AS (SELECT version, arch, function_id, address, norm_name, {nine} FROM shl),
{window('wl', 'l', 's', 96, 'address, function_id')}, {window('ws', 's', 'l', 96, 'address, function_id')},
bl AS (SELECT version, arch, function_id AS label_id, c_function_id AS function_id, {gap(5)} AS match_dist FROM wl QUALIFY row_number() OVER (PARTITION BY version, arch, label_id ORDER BY match_dist, c_log_size, idx) = 1),
bs AS (SELECT version, arch, function_id, c_function_id AS label_id FROM ws QUALIFY row_number() OVER (PARTITION BY version, arch, function_id ORDER BY {gap(5)}, c_log_size, idx) = 1),
sh AS (SELECT shs.* EXCLUDE (norm_name), mlab.norm_name, round(1.0::DOUBLE / (1.0::DOUBLE + bl.match_dist), 6) AS confidence FROM bl JOIN bs USING (version, arch, label_id, function_id) JOIN shs USING (version, arch, function_id) JOIN mlab ON mlab.function_id = bl.label_id WHERE bl.match_dist <= 0.20)"""


def methods(fitted: str, tested: str, matched: bool = False) -> str:
    """CTEs up to m: metrics a pair and method. fitted, tested: conditions on a record's version."""
    scale = lambda x, m, s: f"list_transform(range(1, len({x}) + 1), lambda i: ({x}[i] - {m}[i]) / {s}[i])"
    scales = (1.0, 0.2, 0.2, 1.0, 1.0)
    gaps = " + ".join(f"pow((q.shp[{i}] - c.shp[{i}]) / {s}::DOUBLE, 2)" for i, s in enumerate(scales, 1))
    cosines = ", ".join(f"{_cosine(f'q.{n}', f'c.{n}')} AS {n}_s" for n in ("token", "graph", "graph_arch", "context", "shape_arch", "fused"))
    each = ", ".join(f"{{'method': '{m}', 'score': round({e}, 9)}}" for m, e in _METHODS.items())
    return f"""WITH {records(fitted, matched)},
{_moments('gall', 'raw', False)}, {_moments('garch', 'raw', True)}, {_moments('sarch', 'shp', True)}, {_hashed('tokens', 'tok:', 256)}, {_hashed('contexts', 'ctx:', 64)},
vec0 AS (SELECT base.*, t.v AS token, x.v AS context, {scale('raw', 'gall.mean', 'gall.std')} AS graph, {scale('raw', 'coalesce(garch.mean, gall.mean)', 'coalesce(garch.std, gall.std)')} AS graph_arch,
 CASE WHEN sarch.mean IS NULL THEN shp ELSE {scale('shp', 'sarch.mean', 'sarch.std')} END AS shape_arch FROM base JOIN tokensv t USING (function_id) JOIN contextsv x USING (function_id) CROSS JOIN gall LEFT JOIN garch ON garch.arch = base.arch LEFT JOIN sarch ON sarch.arch = base.arch),
vec AS (SELECT *, list_concat(list_concat(token, graph_arch), list_concat(context, shape_arch)) AS fused FROM vec0),
pm AS (SELECT tested, norm_name, list(x ORDER BY i) AS proto FROM (SELECT tested, norm_name, i, avg(x) AS x FROM (SELECT t.version AS tested, norm_name, unnest(fused) AS x, unnest(range(len(fused))) AS i
 FROM vec JOIN (SELECT DISTINCT version FROM vec) t ON t.version <> vec.version WHERE fitted) GROUP BY ALL) GROUP BY ALL),
fx AS (SELECT * FROM vec WHERE {tested}), {PAIRS}, {relevant('fx')},
sc AS (SELECT q.version, q.src_arch, q.dst_arch, q.function_id, q.norm_name, c.norm_name AS c_name, c.address AS c_address, c.confidence AS c_confidence, -abs(q.shp[1] - c.shp[1]) AS size_s, -({gaps}) AS shape_s, {cosines},
 CASE WHEN p.proto IS NULL THEN 0.0::DOUBLE ELSE {_cosine('p.proto', 'c.fused')} END AS proto_s
 FROM rq q JOIN fx c ON c.version = q.version AND c.arch = q.dst_arch LEFT JOIN pm p ON p.norm_name = q.norm_name AND p.tested = q.version),
sm AS (SELECT version, src_arch, dst_arch, function_id, norm_name, c_name, c_address, c_confidence, unnest([{each}], recursive := true) FROM sc),
rk AS (SELECT *, row_number() OVER (PARTITION BY version, src_arch, dst_arch, function_id, method ORDER BY score DESC, c_confidence, c_address DESC, c_name DESC) AS rnk FROM sm QUALIFY rnk <= 10),
fs AS (SELECT version, src_arch, dst_arch, function_id, method, min(rnk) FILTER (c_name = norm_name) AS first FROM rk GROUP BY ALL), cn AS (SELECT version, arch AS dst_arch, count(*) AS candidates FROM vec GROUP BY ALL),
m AS (SELECT version, src_arch, dst_arch, method, candidates, count(*) AS queries, avg(CASE WHEN first <= 1 THEN 1.0::DOUBLE ELSE 0 END) AS hit_at_1, avg(CASE WHEN first <= 5 THEN 1.0::DOUBLE ELSE 0 END) AS hit_at_5,
 avg(CASE WHEN first <= 10 THEN 1.0::DOUBLE ELSE 0 END) AS hit_at_10, avg(coalesce(1.0::DOUBLE / first, 0)) AS mrr_at_10, avg(CAST(coalesce(first, 11) AS DOUBLE)) AS mean_inspected_at_10 FROM fs JOIN cn USING (version, dst_arch) GROUP BY ALL)"""


def temporal(low: str, high: str) -> str:
    """CTEs up to tv and tp: fused vectors (v) and prototypes (p) of every version from low to high, fitted anew on the versions before it."""
    hashed = lambda c, prefix, dims: f"""{c}o AS (SELECT tested, function_id, fitted, len({c}) AS total, unnest({c}) AS token FROM rt), {c}c AS (SELECT tested, function_id, fitted, token, total, count(*) AS n FROM {c}o GROUP BY ALL),
{c}d AS (SELECT tested, token, count(*) FILTER (fitted) AS df, ln((1.0::DOUBLE + any_value(nf)) / (1.0::DOUBLE + count(*) FILTER (fitted))) + 1.0::DOUBLE AS idf FROM {c}c JOIN tfit USING (tested) GROUP BY tested, token),
{c}h AS (SELECT tested, function_id, ('0x' || substr(md5('{prefix}' || token), 1, 8))::BIGINT AS h, n::DOUBLE / total * idf AS weight FROM {c}c JOIN {c}d USING (tested, token)),
{c}s AS (SELECT tested, function_id, h % {dims} AS slot, sum(CASE WHEN (h >> 8) & 1 = 1 THEN -weight ELSE weight END) AS value FROM {c}h GROUP BY ALL),
{c}v AS (SELECT r.tested, r.function_id, list(coalesce(value, 0.0::DOUBLE) ORDER BY i) AS v FROM (SELECT tested, function_id, unnest(range({dims})) AS i FROM rt) r LEFT JOIN {c}s s ON s.tested = r.tested AND s.function_id = r.function_id AND s.slot = r.i GROUP BY ALL)"""  # noqa: E731
    moments = lambda name, c, arch: f"""{name} AS (SELECT tested, {arch}list(mean ORDER BY i) AS mean, list(std ORDER BY i) AS std FROM (SELECT tested, {arch}i, avg(x) AS mean, CASE WHEN var_pop(x) <= 1e-9 THEN 1.0::DOUBLE ELSE sqrt(var_pop(x)) END AS std
 FROM (SELECT tested, arch, unnest({c}) AS x, unnest(range(len({c}))) AS i FROM rt WHERE fitted) GROUP BY ALL) GROUP BY ALL)"""  # noqa: E731
    scale = lambda x, m, s: f"list_transform(range(1, len({x}) + 1), lambda i: ({x}[i] - {m}[i]) / {s}[i])"
    return f"""WITH {records('true')}, tested AS (SELECT DISTINCT version AS tested FROM base WHERE version BETWEEN '{low}' AND '{high}' AND version > (SELECT min(version) FROM base)),
rt AS (SELECT tested, b.* EXCLUDE (fitted), b.version < tested AS fitted, r.tokens, r.contexts FROM base b JOIN rec r USING (function_id) JOIN tested ON b.version <= tested), tfit AS (SELECT tested, count(*) FILTER (fitted) AS nf FROM rt GROUP BY tested),
{hashed('tokens', 'tok:', 256)}, {hashed('contexts', 'ctx:', 64)}, {moments('gall', 'raw', '')}, {moments('garch', 'raw', 'arch, ')}, {moments('sarch', 'shp', 'arch, ')},
tv AS (SELECT rt.tested, rt.version, rt.arch, rt.function_id, rt.norm_name, rt.address, rt.fitted, rt.shp, list_concat(list_concat(t.v, {scale('raw', 'coalesce(garch.mean, gall.mean)', 'coalesce(garch.std, gall.std)')}), list_concat(x.v, CASE WHEN sarch.mean IS NULL THEN shp ELSE {scale('shp', 'sarch.mean', 'sarch.std')} END)) AS v
 FROM rt JOIN tokensv t USING (tested, function_id) JOIN contextsv x USING (tested, function_id) JOIN gall USING (tested) LEFT JOIN garch ON garch.tested = rt.tested AND garch.arch = rt.arch LEFT JOIN sarch ON sarch.tested = rt.tested AND sarch.arch = rt.arch),
tl AS (SELECT tested, norm_name, i AS dim, avg(x) AS value FROM (SELECT tested, norm_name, unnest(v) AS x, unnest(range(len(v))) AS i FROM tv WHERE fitted) GROUP BY ALL),
tp AS (SELECT tested, norm_name, list(value ORDER BY dim) AS p FROM tl GROUP BY ALL)"""


_LOOKUP = f"""{LOVO}, pl AS (SELECT t.vec_id, t.version, t.norm_name, sum(t.x * pv.value) AS d, sum(t.x * t.x) AS aa, sum(pv.value * pv.value) AS bb FROM long t JOIN pv ON pv.tn > 0 AND pv.test_version = t.version AND pv.norm_name = t.norm_name AND pv.dim = t.dim GROUP BY ALL),
lk AS (SELECT vec.vec_id, vec.version, vec.norm_name, vec.v, round(coalesce(CASE WHEN aa > 1e-12 AND bb > 1e-12 THEN d / sqrt(aa * bb) ELSE 0 END, 0), 6) AS proto_score FROM vec LEFT JOIN pl USING (vec_id))"""

def window(name: str, q: str, c: str, reach: int, ties: str, arch: str = "arch") -> str:
    """name: each row of q beside the rows of c (as c_...) in the window of places around its log_size."""
    return f"""{name}i AS (SELECT *, row_number() OVER (PARTITION BY version, arch ORDER BY log_size, {ties}) - 1 AS idx FROM {c}),
{name}s AS (SELECT version, arch, log_size, min(idx) AS pos FROM {name}i GROUP BY ALL), {name}n AS (SELECT version, arch, count(*) AS n FROM {c} GROUP BY ALL),
{name}p AS (SELECT x.*, coalesce(s.pos, n.n) AS pos, n.n AS cn, least(n.n, {2 * reach + 1}) AS width FROM {q} x JOIN {name}n n ON n.version = x.version AND n.arch = x.{arch} ASOF LEFT JOIN {name}s s ON s.version = x.version AND s.arch = x.{arch} AND s.log_size >= x.log_size),
{name} AS (SELECT p.*, c.idx, {', '.join(f'c.{k} AS c_{k}' for k in (*_SHAPE, 'address', 'norm_name', 'function_id'))} FROM {name}p p JOIN {name}i c ON c.version = p.version AND c.arch = p.{arch} AND c.idx BETWEEN greatest(0, least(pos - {reach}, cn - width)) AND greatest(0, least(pos - {reach}, cn - width)) + width - 1)"""


def gap(dims: int) -> str:
    return " + ".join(f"(({c} - c_{c}) / {s!r}::DOUBLE) * (({c} - c_{c}) / {s!r}::DOUBLE)" for c, s in zip(_SHAPE[:dims], _SCALES[:dims], strict=True))



TWO = f"""{SIZE_PAIRS}, {shaped('sh', 'fx')}, qs AS (SELECT rq.version, rq.src_arch, rq.dst_arch, rq.function_id, rq.norm_name, {', '.join(f'sh.{c}' for c in _SHAPE)} FROM rq JOIN sh ON sh.version = rq.version AND sh.arch = rq.src_arch AND sh.function_id = rq.function_id),
{window('wq', 'qs', 'sh', 64, 'address, size, norm_name, function_id', 'dst_arch')},
sr AS (SELECT version, src_arch, dst_arch, function_id, norm_name, c_norm_name, row_number() OVER (PARTITION BY version, src_arch, dst_arch, function_id ORDER BY round({gap(5)}, 9), c_address, c_norm_name, c_function_id) AS rnk FROM wq),
sf AS (SELECT version, src_arch, dst_arch, function_id, min(rnk) AS first FROM sr WHERE rnk <= 10 AND c_norm_name = norm_name GROUP BY ALL),
sm AS (SELECT qs.version, qs.src_arch, qs.dst_arch, count(*) AS queries, avg(CASE WHEN first <= 1 THEN 1.0::DOUBLE ELSE 0 END) AS hit_at_1, avg(CASE WHEN first <= 5 THEN 1.0::DOUBLE ELSE 0 END) AS hit_at_5,
 avg(CASE WHEN first <= 10 THEN 1.0::DOUBLE ELSE 0 END) AS hit_at_10, avg(coalesce(1.0::DOUBLE / first, 0)) AS mrr_at_10, avg(CAST(coalesce(first, 11) AS DOUBLE)) AS mean_inspected_at_10
 FROM qs LEFT JOIN sf USING (version, src_arch, dst_arch, function_id) GROUP BY ALL),
two AS (SELECT 'size' AS method, version, src_arch, dst_arch, queries, hit_at_1, hit_at_5, hit_at_10, mrr_at_10, mean_inspected_at_10 FROM m
 UNION ALL SELECT 'shape', version, src_arch, dst_arch, queries, hit_at_1, hit_at_5, hit_at_10, mrr_at_10, mean_inspected_at_10 FROM sm)"""
PD = f"{TWO}, pd AS (SELECT a.version, a.src_arch, a.dst_arch, a.queries, a.hit_at_10 - c.hit_at_10 AS difference FROM two a JOIN two c USING (version, src_arch, dst_arch) WHERE a.method = 'shape' AND c.method = 'size'), pr AS (SELECT * REPLACE (round(difference, 6) AS difference) FROM pd)"

SQL: dict[str, str] = {
    "normalize_name": f"WITH {FX} SELECT function_id, name, regexp_replace(split_part(trim(name), '@', 1), '(\\.constprop\\.[0-9]+|\\.isra\\.[0-9]+|\\.part\\.[0-9]+|\\.cold(\\.[0-9]+)?|\\.localalias(\\.[0-9]+)?)+$', '') AS clean_name FROM fx",
    "analysis_filter": f"""WITH {FX}, x AS (SELECT version, arch, CASE l_suppkey % 7 WHEN 0 THEN concat('__', name) WHEN 1 THEN '_start' WHEN 2 THEN concat('.', name) ELSE name END AS n, CASE l_linenumber % 5 WHEN 0 THEN 'UND' WHEN 1 THEN 'ABS' ELSE '12' END AS s, size % 50 AS z FROM fx),
 k AS (SELECT *, n <> '' AND z > 0 AND s NOT IN ('UND', 'ABS', 'COM') AND n NOT IN ('_start', 'init', 'fini', '_init', '_fini') AND NOT starts_with(n, '.') AND NOT starts_with(n, '__') AS kept FROM x)
 SELECT version, arch, count(*) FILTER (kept) AS kept, count(*) FILTER (NOT kept) AS dropped FROM k GROUP BY ALL""",
    "version_labels": f"WITH {FX} SELECT version, {KEY3}[1] AS major, {KEY3}[2] AS minor, {KEY3}[3] AS patch, CAST({RANGE_LABEL} AS INT) AS label, {SPLIT} AS split, functions FROM (SELECT version, count(*) AS functions FROM fx GROUP BY version)",
    "select_binaries": f"WITH {FX} SELECT version, arch, count(*) AS functions, CAST(sum(size) AS BIGINT) AS bytes FROM fx WHERE version IN ('rel-1.30.0', 'rel-1.32.0', 'rel-1.34.0') AND arch IN ('1-URGENT', '2-HIGH', '3-MEDIUM') GROUP BY ALL",
    "classify_mnemonic": f"WITH {DOCS}, w AS (SELECT w, count(*) AS n FROM (SELECT unnest(tokens) AS w FROM docs) GROUP BY w) SELECT {mnemonic_case('w')} AS op_class, CAST(sum(n) AS BIGINT) AS n, count(*) AS words FROM w GROUP BY ALL",
    "imm_bucket": f"WITH v AS (SELECT l_partkey - 1000 AS v FROM lineitem UNION ALL SELECT l_orderkey * l_partkey FROM lineitem) SELECT {bucket_case('v')} AS bucket, count(*) AS n FROM v GROUP BY ALL",
    "string_category": f"""WITH s AS (SELECT unnest(string_split(text, chr(10))) AS s FROM documents UNION ALL SELECT url FROM pages), t AS (SELECT coalesce(s, '') AS s FROM s)
 SELECT {category_case('s')} AS category, count(*) AS n FROM t GROUP BY ALL""",
    "instruction_token": f"""WITH {FX}, x AS (SELECT CASE l_linenumber % 4 WHEN 0 THEN concat('[sp, #', l_suppkey, ']') WHEN 1 THEN concat('0x', l_partkey, '(r7)') WHEN 2 THEN concat('#', l_partkey - 1000) ELSE 'r1' END AS t, CASE l_linenumber % 4 WHEN 2 THEN 'scalar' WHEN 3 THEN 'reg' END AS kind, l_partkey - 1000 AS v, ['ldr','str','add.w','cmp','bl','mov','b.eq','push','nop'][1 + l_suppkey % 9] AS mn FROM fx),
 r AS (SELECT mn, CASE WHEN ((contains(t, '[') AND contains(t, ']')) OR (contains(t, '(') AND contains(t, ')'))) THEN CASE WHEN {_STACK} THEN 'MEM_STACK' ELSE 'MEM' END WHEN kind = 'reg' THEN 'REG' WHEN kind = 'scalar' THEN {bucket_case('v')} WHEN t <> '' THEN 'OPERAND' ELSE 'NONE' END AS role FROM x)
 SELECT concat({mnemonic_case('mn')}, ' ', role) AS token, count(*) AS n FROM r GROUP BY ALL""",
    "file_inventory": "SELECT doc_id, source, lang, CAST(strlen(text) AS BIGINT) AS size_bytes, sha256(text) AS sha256 FROM documents",
    "symbol_stats": f"WITH {FX}, {STATS} SELECT version, arch, functions, round(mean, 6) AS mean, round(median, 6) AS median, round(p90, 6) AS p90, round(p99, 6) AS p99 FROM st",
    "size_map": f"WITH {FX}, {SMAP} SELECT * FROM smap",
    "dataset_summary": f"WITH {FX} SELECT arch, count(*) AS functions, count(DISTINCT version) AS versions, CAST(sum(size) AS BIGINT) AS bytes, min(version) AS first_version, max(version) AS last_version FROM fx GROUP BY ROLLUP (arch)",
    "coverage": f"WITH {FX} SELECT version, count(DISTINCT arch) AS completed, count(*) AS functions, CAST(count(DISTINCT arch) >= 5 AS INT) AS is_complete FROM fx GROUP BY version",
    "step_counts": "SELECT event_type AS step, CASE WHEN value < 5 THEN 'failed' ELSE 'completed' END AS status, count(*) AS n, round(avg(value), 6) AS mean_sec, round(max(value), 6) AS max_sec FROM events GROUP BY ALL",
    "build_grid": "WITH e AS (SELECT event_type AS version, concat('h', CAST(hour(ts) AS VARCHAR)) AS arch, max(CASE WHEN value < 5 THEN 0 ELSE 1 END) AS ok FROM events GROUP BY ALL), g AS (SELECT * FROM (SELECT DISTINCT version FROM e), (SELECT DISTINCT arch FROM e)) SELECT g.version, g.arch, CASE ok WHEN 1 THEN 'OK' WHEN 0 THEN 'FAIL' ELSE 'MISSING' END AS result FROM g LEFT JOIN e USING (version, arch)",
    "pair_artifacts": f"WITH {FX}, {LAB}, {STR}, s AS (SELECT version, arch, count(*) AS stripped_size FROM strip GROUP BY ALL), u AS (SELECT DISTINCT version, arch, 1 AS h FROM lab WHERE quantity > 10 AND version < 'rel-1.35.0') SELECT version, arch, stripped_size, coalesce(h, 0) AS has_label, CASE WHEN h = 1 THEN 'paired' ELSE 'stripped_only' END AS label_status FROM s LEFT JOIN u USING (version, arch)",
    "shape_features": f"WITH {FX}, {shaped('sh', 'fx')} SELECT function_id, version, arch, address, size, {', '.join(f'round({c}, 6) AS {c}' for c in _SHAPE)} FROM sh",
    "binary_shape_stats": f"WITH {FX}, {shaped('sh', 'fx')} SELECT version, arch, {', '.join(f'round(avg({c}), 6) AS {c}_mean, round(CASE WHEN stddev_pop({c}) <= 1e-9 THEN 1 ELSE stddev_pop({c}) END, 6) AS {c}_std' for c in _SHAPE)} FROM sh GROUP BY ALL",
    "size_histogram": f"WITH {FX} SELECT CAST(floor(ln(1.0::DOUBLE + size) / 12 * 18) + 1 AS BIGINT) AS bin, count(*) AS n FROM fx GROUP BY ALL",
    "arch_pairs": f"WITH {FX}, {PAIRS} SELECT * FROM pairs",
    "relevant_queries": f"WITH {FX}, {PAIRS}, {relevant('fx')} SELECT version, src_arch, dst_arch, count(*) AS queries FROM rq GROUP BY ALL",
    "systematic_sample": f"WITH {FX}, {PAIRS}, {relevant('fx')}, {sampled(300)} SELECT version, src_arch, dst_arch, function_id FROM q",
    "random_expectation": f"WITH {FX}, {PAIRS}, {relevant('fx')}, {RANDOM} SELECT version, src_arch, dst_arch, queries, round(h1, 6) AS random_hit_at_1, round(h5, 6) AS random_hit_at_5, round(h10, 6) AS random_hit_at_10 FROM rnd",
    "cross_arch_size_retrieval": f"{SIZE_PAIRS} SELECT m.version, src_arch, dst_arch, queries, candidates, {', '.join(f'round({x}, 9) AS {x}' for x in _M)} FROM m JOIN cn ON cn.version = m.version AND cn.arch = m.dst_arch",
    "summary_by_method": f"{TWO} SELECT method, count(*) AS pairs, CAST(sum(queries) AS BIGINT) AS queries, {AGGS} FROM two GROUP BY method",
    "summary_by_version": f"{TWO}, s AS (SELECT version, method, count(*) AS pairs, CAST(sum(queries) AS BIGINT) AS queries, {AGGS} FROM two GROUP BY ALL) SELECT *, row_number() OVER (PARTITION BY version ORDER BY round(weighted_hit_at_1, 6) DESC, round(weighted_hit_at_10, 6) DESC, round(weighted_mrr_at_10, 6) DESC, round(weighted_mean_inspected_at_10, 6), method) AS rank FROM s",
    "pair_matrix": f"{SIZE_PAIRS} SELECT src_arch, {', '.join(f'round(avg(hit_at_10) FILTER (dst_arch = {a!r}), 6) AS to_{i}' for i, a in enumerate(('1-URGENT', '2-HIGH', '3-MEDIUM', '4-NOT SPECIFIED', '5-LOW'), 1))} FROM m GROUP BY src_arch",
    "paired_methods": f"{PD} SELECT version, src_arch, dst_arch, queries, round(difference, 6) AS difference FROM pd",
    "wilcoxon": f"{PD}, d AS (SELECT difference, round(abs(difference), 12) AS s FROM pr WHERE difference <> 0), k AS (SELECT difference, rank() OVER (ORDER BY s) + (count(*) OVER (PARTITION BY s) - 1) / 2.0::DOUBLE AS r, CAST(count(*) OVER (PARTITION BY s) AS DOUBLE) AS t FROM d), a0 AS (SELECT CAST(count(*) AS DOUBLE) AS n, sum(CASE WHEN difference > 0 THEN r ELSE 0 END) AS p, sum(CASE WHEN difference < 0 THEN r ELSE 0 END) AS m, sum(t * t - 1) AS tied FROM k), a AS (SELECT *, abs(least(p, m) - n * (n + 1) / 4) / sqrt(n * (n + 1) * (2 * n + 1) / 24 - tied / 48) AS u, (SELECT 2 / sqrt(pi()) * sum(exp(-1 * pow((i + 0.5) / 20000 * u / sqrt(2), 2))) * u / sqrt(2) / 20000 FROM range(20000) t(i)) AS erf_z FROM a0) SELECT CAST(n AS BIGINT) AS n, round(least(p, m), 6) AS w, round((least(p, m) - n * (n + 1) / 4) / sqrt(n * (n + 1) * (2 * n + 1) / 24 - tied / 48), 6) AS z, round(1 - erf_z, 4) AS p FROM a",
    "weighted_difference": f"{PD} SELECT version, count(*) AS pairs, round(sum(difference * queries) / greatest(sum(queries), 1), 6) AS weighted_difference FROM pd GROUP BY version",
    "block_bootstrap": f"{PD}, bl AS (SELECT version, sum(difference * queries) AS s, sum(queries) AS q, row_number() OVER (ORDER BY version) - 1 AS k, count(*) OVER () AS n FROM pr GROUP BY version), dr AS (SELECT i, ('0x' || substr(md5('7-' || i || '-' || j), 1, 8))::BIGINT % (SELECT max(n) FROM bl) AS k FROM range(20000) a(i), range((SELECT max(n) FROM bl)) c(j)), me AS (SELECT i, sum(s) / greatest(sum(q), 1) AS mean FROM dr JOIN bl USING (k) GROUP BY i) SELECT round(avg(mean), 6) AS mean, round(quantile_cont(mean, 0.025), 6) AS low, round(quantile_cont(mean, 0.975), 6) AS high FROM me",
    "version_change": f"{CHANGE} SELECT arch, old, new, norm_name, old_size, new_size, abs_change, round(rel_change, 6) AS rel_change FROM ch",
    "change_transfer": f"""{CHANGE}, cr AS (SELECT * REPLACE (round(rel_change, 9) AS rel_change) FROM ch), p AS (SELECT a.old, a.new, a.norm_name, a.arch AS src_arch, c.arch AS dst_arch, a.rel_change AS score, CAST(c.rel_change >= 0.05 AND c.abs_change >= 16 AS INT) AS label FROM cr a JOIN cr c ON a.old = c.old AND a.new = c.new AND a.norm_name = c.norm_name AND a.arch <> c.arch),
 k AS (SELECT *, rank() OVER (PARTITION BY old, new, src_arch, dst_arch ORDER BY score) + (count(*) OVER (PARTITION BY old, new, src_arch, dst_arch, score) - 1) / 2.0::DOUBLE AS ar, row_number() OVER d AS pl, sum(label) OVER (PARTITION BY old, new, src_arch, dst_arch ORDER BY score DESC, norm_name ROWS UNBOUNDED PRECEDING) AS fo FROM p WINDOW d AS (PARTITION BY old, new, src_arch, dst_arch ORDER BY score DESC, norm_name)),
 g AS (SELECT old, new, src_arch, dst_arch, count(*) AS n, CAST(sum(label) AS BIGINT) AS positives, sum(ar) FILTER (label = 1) AS rs, sum(fo::DOUBLE / pl) FILTER (label = 1) AS ps FROM k GROUP BY ALL)
 SELECT old, new, src_arch, dst_arch, n, positives, round((rs - positives::DOUBLE * (positives + 1) / 2) / (positives::DOUBLE * (n - positives)), 6) AS auc, round(ps / positives, 6) AS average_precision FROM g WHERE n >= 20 AND positives > 0 AND positives < n""",
    "patch_probe": f"WITH {FX}, {SMAP}, a AS (SELECT arch, norm_name, size AS old_size FROM smap WHERE version = 'rel-1.31.0' AND contains(norm_name, 'fn_1')), c AS (SELECT arch, norm_name, size AS new_size FROM smap WHERE version = 'rel-1.32.0' AND contains(norm_name, 'fn_1')) SELECT arch, norm_name, old_size, new_size, CASE WHEN old_size IS NULL THEN 'appeared' WHEN new_size IS NULL THEN 'removed' WHEN old_size <> new_size THEN 'changed' ELSE 'unchanged' END AS state, coalesce(new_size, 0) - coalesce(old_size, 0) AS delta, round(CASE WHEN old_size IS NULL OR new_size IS NULL THEN 1.0::DOUBLE ELSE abs(new_size - old_size)::DOUBLE / greatest(old_size, new_size, 1) END, 6) AS rel_change FROM a FULL JOIN c USING (arch, norm_name)",
    "nearest_centroid": f"{_centroid()} SELECT version, arch, label, predicted FROM pred",
    "classification_metrics": f"""{_centroid()}, c AS (SELECT arch, count(*) FILTER (label = 1 AND predicted = 1) AS tp, count(*) FILTER (label = 0 AND predicted = 0) AS tn, count(*) FILTER (label = 0 AND predicted = 1) AS fp, count(*) FILTER (label = 1 AND predicted = 0) AS fn FROM pred GROUP BY arch)
 SELECT arch, tp, tn, fp, fn, round((tp + tn)::DOUBLE / (tp + tn + fp + fn), 6) AS accuracy, round(CASE WHEN tp + fp > 0 THEN tp::DOUBLE / (tp + fp) ELSE 0 END, 6) AS precision, round(CASE WHEN tp + fn > 0 THEN tp::DOUBLE / (tp + fn) ELSE 0 END, 6) AS recall, round(CASE WHEN tp > 0 THEN 2::DOUBLE * tp / (2 * tp + fp + fn) ELSE 0 END, 6) AS f1 FROM c""",
    "doc_frequency": f"{TF} SELECT token, df, round(idf, 6) AS idf FROM df",
    "tfidf_norms": f"{TF} SELECT function_id, count(*) AS tokens, round(sqrt(sum(weight * weight)), 6) AS norm FROM w GROUP BY function_id",
    "feature_hashing": f"{TF}, h AS (SELECT function_id, weight, ('0x' || substr(md5('tok:' || token), 1, 8))::BIGINT AS h FROM w) SELECT function_id, CAST(h % 256 AS INT) AS slot, round(sum(CASE WHEN (h >> 8) & 1 = 1 THEN -weight ELSE weight END), 6) AS value FROM h GROUP BY ALL",
    "cosine_sparse": f"""{TF}, ids AS (SELECT doc_id FROM documents), p AS (SELECT concat('doc-', a.doc_id) AS a, concat('doc-', c.doc_id) AS b FROM ids a JOIN ids c ON c.doc_id = a.doc_id + 1), nm AS (SELECT function_id, sum(weight * weight) AS q FROM w GROUP BY function_id), d AS (SELECT a, b, sum(x.weight * y.weight) AS d FROM p JOIN w x ON x.function_id = a JOIN w y ON y.function_id = b AND y.token = x.token GROUP BY ALL)
 SELECT p.a, p.b, round(CASE WHEN m.q > 1e-12 AND n.q > 1e-12 THEN coalesce(d, 0) / sqrt(m.q * n.q) ELSE 0 END, 6) AS cosine FROM p LEFT JOIN d ON d.a = p.a AND d.b = p.b LEFT JOIN nm m ON m.function_id = p.a LEFT JOIN nm n ON n.function_id = p.b""",
    "class_histogram": f"WITH {DOCS}, t AS (SELECT function_id, unnest(tokens) AS token FROM docs) SELECT function_id, {mnemonic_case('token')} AS op_class, count(*) AS n FROM t GROUP BY ALL",
    "function_record": f"""WITH {DOCS}, t AS (SELECT function_id, unnest(tokens) AS token FROM docs), c AS (SELECT function_id, token, {mnemonic_case('token')} AS k, CASE WHEN length(token) > 8 THEN token END AS s, CASE WHEN regexp_full_match(token, '[0-9]{{1,15}}') THEN CAST(token AS BIGINT) END AS v FROM t),
sh AS (SELECT function_id, string_agg(key || '=' || n, ' ' ORDER BY key) AS h FROM (SELECT function_id, {category_case('s')} AS key, count(*) AS n FROM c WHERE s IS NOT NULL GROUP BY ALL) GROUP BY function_id),
vh AS (SELECT function_id, string_agg(key || '=' || n, ' ' ORDER BY key) AS h FROM (SELECT function_id, {bucket_case('v')} AS key, count(*) AS n FROM c WHERE v IS NOT NULL GROUP BY ALL) GROUP BY function_id)
SELECT c.function_id, count(*) AS instruction_count, count(*) FILTER (k = 'CALL') AS call_count, count(*) FILTER (k = 'RET') AS ret_count, count(*) FILTER (starts_with(k, 'BRANCH')) AS branch_count, count(s) AS string_ref_count, count(v) AS constant_count,
 coalesce(any_value(sh.h), '') AS string_refs, coalesce(any_value(vh.h), '') AS constant_buckets, CAST(count(*) > 4096 AS INT) AS token_truncated, any_value(array_to_string(tokens[1:4096], ' ')) AS tokens FROM c JOIN docs USING (function_id) LEFT JOIN sh ON sh.function_id = c.function_id LEFT JOIN vh ON vh.function_id = c.function_id GROUP BY c.function_id""",
    "fit_scalers": f"WITH {VEC}, {LONG} SELECT CAST(dim AS INT) AS dim, arch, count(*) AS n, round(avg(x), 6) AS mean, round(CASE WHEN var_pop(x) <= 1e-9 THEN 1 ELSE sqrt(var_pop(x)) END, 6) AS std FROM long GROUP BY GROUPING SETS ((dim, arch), (dim))",
    "prototypes_other_versions": f"{LOVO} SELECT test_version, norm_name, CAST(dim AS INT) AS dim, round(value, 6) AS value FROM pv WHERE tn > 0",
    "prototypes_earlier_versions": f"{PROTO}, pv AS (SELECT version AS test_version, norm_name, dim, sum(s) OVER e / sum(n) OVER e AS value, sum(n) OVER e AS tn FROM own WINDOW e AS (PARTITION BY norm_name, dim ORDER BY version ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)) SELECT test_version, norm_name, CAST(dim AS INT) AS dim, round(value, 6) AS value FROM pv WHERE tn > 0",
    "cosine_dense": f"WITH {VEC} SELECT a.vec_id AS a, round(CASE WHEN list_dot_product(a.v, a.v) <= 1e-12 OR list_dot_product(c.v, c.v) <= 1e-12 THEN 0 ELSE list_dot_product(a.v, c.v) / sqrt(list_dot_product(a.v, a.v) * list_dot_product(c.v, c.v)) END, 6) AS cosine FROM vec a JOIN vec c ON c.vec_id = a.vec_id + 1",
    "prototype_lookup": f"{_LOOKUP} SELECT vec_id, version, norm_name, proto_score FROM lk",
    "method_scores": f"{methods('true', 'true')} SELECT method, count(*) AS pairs, CAST(sum(queries) AS BIGINT) AS queries, {AGGS} FROM m GROUP BY method",
    "method_retrieval": f"{methods(f'{KEY3} <> [1, 33, 0]', f'{KEY3} = [1, 33, 0]')} SELECT version, src_arch, dst_arch, method, queries, candidates, {_M9} FROM m",
    "method_retrieval_temporal": f"{methods(f'{KEY3} < [1, 33, 0]', f'{KEY3} = [1, 33, 0]')} SELECT version, src_arch, dst_arch, method, queries, candidates, {_M9} FROM m",
}

_ROUNDED = ", ".join(f"round({c}, 9) AS {c}" for c in _SHAPE)
_MUTUAL = f"""WITH {FX}, {LAB}, {STR}, {shaped('shs', 'strip')}, {shaped('shl', 'lab')},
s AS (SELECT version, arch, function_id, address, norm_name, {_ROUNDED} FROM shs), l AS (SELECT version, arch, function_id, address, norm_name, {_ROUNDED} FROM shl),
{window('wl', 'l', 's', 96, 'address, function_id')}, {window('ws', 's', 'l', 96, 'address, function_id')},
bl AS (SELECT version, arch, function_id AS label_id, c_function_id AS function_id, {gap(5)} AS match_dist FROM wl QUALIFY row_number() OVER (PARTITION BY version, arch, label_id ORDER BY match_dist, c_log_size, idx) = 1),
bs AS (SELECT version, arch, function_id, c_function_id AS label_id, {gap(5)} AS match_dist FROM ws QUALIFY row_number() OVER (PARTITION BY version, arch, function_id ORDER BY match_dist, c_log_size, idx) = 1),
mm AS (SELECT bl.version, bl.arch, bl.function_id, bl.label_id, round(bl.match_dist, 6) AS match_dist, round(1.0::DOUBLE / (1.0::DOUBLE + bl.match_dist), 6) AS match_confidence FROM bl JOIN bs USING (version, arch, label_id, function_id) WHERE bl.match_dist <= 0.20)"""
SQL["mutual_match"] = f"{_MUTUAL} SELECT * FROM mm"
SQL["matching_summary"] = f"""{_MUTUAL}, lc AS (SELECT version, arch, count(*) AS labels FROM lab GROUP BY ALL), sc AS (SELECT version, arch, count(*) AS stripped FROM strip GROUP BY ALL),
mc AS (SELECT version, arch, count(*) AS matches, quantile_cont(match_dist, 0.5) AS md, quantile_cont(match_dist, 0.9) AS pd FROM mm GROUP BY ALL)
SELECT version, arch, labels, stripped, coalesce(matches, 0) AS matches, round(md, 8) AS median_dist, round(pd, 8) AS p90_dist, round(coalesce(matches, 0)::DOUBLE / labels, 6) AS label_ratio, round(coalesce(matches, 0)::DOUBLE / stripped, 6) AS stripped_ratio FROM lc JOIN sc USING (version, arch) LEFT JOIN mc USING (version, arch)"""

_MOVED = ", ".join((f"round(d.{c}_m + (q.{c} - s.{c}_m) / s.{c}_s * d.{c}_s, 9)" if c == "log_size" else f"d.{c}_m + (q.{c} - s.{c}_m) / s.{c}_s * d.{c}_s") + f" AS {c}" for c in _SHAPE)


def _windowed() -> str:
    sql = f"""WITH {FX}, {PAIRS}, {shaped('sh', 'fx')}, {relevant('sh')}, {ALL_QUERIES},
st AS (SELECT version, arch, {', '.join(f'avg({c}) AS {c}_m, CASE WHEN stddev_pop({c}) <= 1e-9 THEN 1 ELSE stddev_pop({c}) END AS {c}_s' for c in _SHAPE)} FROM sh GROUP BY ALL),
cnd AS (SELECT version, arch AS dst_arch, count(*) AS candidates FROM fx GROUP BY ALL),
qa AS (SELECT version, src_arch, dst_arch, function_id, norm_name, {', '.join(_SHAPE)} FROM q),
qb AS (SELECT q.version, q.src_arch, q.dst_arch, q.function_id, q.norm_name, {_MOVED} FROM q JOIN st s ON s.version = q.version AND s.arch = q.src_arch JOIN st d ON d.version = q.version AND d.arch = q.dst_arch),
{window('wa', 'qa', 'sh', 64, 'address, size, norm_name, function_id', 'dst_arch')}, {window('wb', 'qb', 'sh', 64, 'address, size, norm_name, function_id', 'dst_arch')},
ranked AS (SELECT * FROM (
 SELECT 'SizeStat' AS method, version, src_arch, dst_arch, function_id, norm_name, c_norm_name AS c_name, row_number() OVER (PARTITION BY version, src_arch, dst_arch, function_id ORDER BY round({gap(1)}, 9), c_address, c_norm_name, c_function_id) AS rnk FROM wa
 UNION ALL SELECT 'ShapeStat', version, src_arch, dst_arch, function_id, norm_name, c_norm_name, row_number() OVER (PARTITION BY version, src_arch, dst_arch, function_id ORDER BY round({gap(5)}, 9), c_address, c_norm_name, c_function_id) FROM wa
 UNION ALL SELECT 'DistCalibratedShape', version, src_arch, dst_arch, function_id, norm_name, c_norm_name, row_number() OVER (PARTITION BY version, src_arch, dst_arch, function_id ORDER BY round({gap(5)}, 9), c_address, c_norm_name, c_function_id) FROM wb) WHERE rnk <= 10),
firsts AS (SELECT method, version, src_arch, dst_arch, function_id, min(rnk) AS first FROM ranked WHERE c_name = norm_name GROUP BY ALL),
qm AS (SELECT method, q.version, q.src_arch, q.dst_arch, q.function_id FROM q, (VALUES ('SizeStat'), ('ShapeStat'), ('DistCalibratedShape')) t(method))
SELECT method, version, src_arch, dst_arch, count(*) AS queries, any_value(candidates) AS candidates, round(avg(CASE WHEN first <= 1 THEN 1.0::DOUBLE ELSE 0 END), 9) AS hit_at_1, round(avg(CASE WHEN first <= 5 THEN 1.0::DOUBLE ELSE 0 END), 9) AS hit_at_5,
 round(avg(CASE WHEN first <= 10 THEN 1.0::DOUBLE ELSE 0 END), 9) AS hit_at_10, round(avg(coalesce(1.0::DOUBLE / first, 0)), 9) AS mrr_at_10, round(avg(CAST(coalesce(first, 11) AS DOUBLE)), 9) AS mean_inspected_at_10
FROM qm LEFT JOIN firsts USING (method, version, src_arch, dst_arch, function_id) JOIN cnd USING (version, dst_arch) GROUP BY ALL"""
    return sql


SQL["windowed_retrieval"] = _windowed()

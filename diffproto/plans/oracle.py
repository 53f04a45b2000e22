"""DuckDB SQL twins of the registered queries (the correctness oracle).

Each string runs on DuckDB with the driver tables registered as views.  The
view rules of ``sources.tables`` are re-stated here as CTEs, so the oracle
re-derives everything from the raw tables independently of Spark.
"""

from __future__ import annotations

from ..sources import runlogs
from ..sources import tables as TB
from ..operators.baseline import L2, RIDGE
from . import registry as RG
from .sweep import REFERENCE_SEEDS, REFERENCE_SHOTS

STRIP = r"'^[\s\x0B\p{Z}\x1c-\x1f\x85]+|[\s\x0B\p{Z}\x1c-\x1f\x85]+$'"
NON_BLANK = r"'[^ \t\r\f\x0B]'"
TOKEN_SPLIT = r"'[^\p{L}\p{N}]+'"


def clean(x: str) -> str:
    return (f"replace(replace(replace(replace({x}, '-LRB-', '('), '-RRB-', ')'), "
            f"'-LSB-', '['), '-RSB-', ']')")


def bracketed(x: str) -> str:
    for word, token in RG.BRACKETED:
        x = f"replace({x}, '{word}', '{token}')"
    return x


def strip(x: str) -> str:
    return f"regexp_replace({x}, {STRIP}, '', 'g')"


def norm_evidence(x: str) -> str:
    return strip(f"lower({clean(x)})")


def norm_claim(x: str) -> str:
    return clean(strip(f"lower({x})"))


def lines(x: str) -> str:
    return f"list_filter(string_split({x}, chr(10)), lambda l: regexp_matches(l, {NON_BLANK}))"


def code3(word: str, words=("SUPPORTS", "NOT ENOUGH INFO", "REFUTES")) -> str:
    return (f"(CASE {word} WHEN '{words[0]}' THEN 0 WHEN '{words[1]}' THEN 1 "
            f"WHEN '{words[2]}' THEN 2 END)::INTEGER")


def letter3(x: str) -> str:
    return f"(CASE WHEN {x} = 0 THEN 's' WHEN {x} = 1 THEN 'n' ELSE 'c' END)"


def letter2(x: str) -> str:
    return f"(CASE WHEN {x} = 0 THEN 's' ELSE 'not' END)"


def lsum(x: str) -> str:
    return f"list_sum({x})"


def vnorm(a: str) -> str:
    return f"sqrt(list_sum(list_transform({a}, lambda x: x * x)))"


def vdot(a: str, b: str) -> str:
    return f"list_sum(list_transform(list_zip({a}, {b}), lambda p: p[1] * p[2]))"


def ved(a: str, b: str) -> str:
    return f"sqrt(list_sum(list_transform(list_zip({a}, {b}), lambda p: (p[1] - p[2]) * (p[1] - p[2]))))"


def vabsdiff(e: str, c: str) -> str:
    return f"list_transform(list_zip({e}, {c}), lambda p: abs(p[1] - p[2]))"


def vsigned(e: str, c: str) -> str:
    return f"list_transform(list_zip({e}, {c}), lambda p: p[1] - p[2])"


def order_key(seed: str, a: str = "claim_id", b: str = "set_pos") -> str:
    return f"md5(concat_ws(':', ({seed})::VARCHAR, {a}::VARCHAR, {b}::VARCHAR))"


def hash_vec(text: str, d: int) -> str:
    buckets = (f"list_transform(list_filter(regexp_split_to_array(lower({text}), {TOKEN_SPLIT}), "
               f"lambda t: t <> ''), lambda t: ('0x' || substr(md5(t), 1, 8))::BIGINT % {d})")
    return f"list_transform(range({d}), lambda i: len(list_filter({buckets}, lambda x: x = i))::DOUBLE)"


def l2n(v: str) -> str:
    return (f"(CASE WHEN {vnorm(v)} = 0 THEN {v} "
            f"ELSE list_transform({v}, lambda x: x / {vnorm(v)}) END)")


def argmax_label(vec: str, packed: str, metric: str = "euclidean") -> str:
    if metric == "euclidean":
        sim = f"1.0 - {ved(vec, 'q.centroid')}"
    else:
        sim = (f"(CASE WHEN {vnorm(vec)} * {vnorm('q.centroid')} = 0 THEN 'nan'::DOUBLE "
               f"ELSE {vdot(vec, 'q.centroid')} / ({vnorm(vec)} * {vnorm('q.centroid')}) END)")
    sims = f"list_transform({packed}, lambda q: {sim})"
    return f"({packed}[list_position({sims}, list_max({sims}))]).label"


# ------------------------------------------------------------------ views

VEC_PAIRS = """
emb_n AS (SELECT count(*) AS n FROM embeddings),
vec_pairs AS (
  SELECT a.vec_id::BIGINT AS claim_id, w.k::INTEGER AS set_pos, (a.vec_id * 3 + w.k)::BIGINT AS pair_id,
         w.k::INTEGER AS label,
         list_transform(a.embedding, lambda x: x::DOUBLE) AS claim_vec,
         list_transform(list_zip(a.embedding, b.embedding),
                        lambda p: p[1]::DOUBLE * w.wa + p[2]::DOUBLE * w.wb) AS evidence_vec
  FROM embeddings a
  CROSS JOIN (VALUES (0, 0.8::DOUBLE, 0.2::DOUBLE), (1, 0.4::DOUBLE, 0.6::DOUBLE),
                     (2, 0.0::DOUBLE, 1.0::DOUBLE)) w(k, wa, wb)
  JOIN embeddings b ON b.vec_id = (a.vec_id + 1 + w.k) % (SELECT n FROM emb_n)
),
fpairs AS (
  SELECT *, """ + vabsdiff("evidence_vec", "claim_vec") + """ AS diff FROM vec_pairs
)"""

NESTED = f"""
doc_lines AS (SELECT doc_id, {lines('text')} AS sentences FROM documents),
nested AS (
  SELECT d.doc_id::BIGINT AS claim_id, d.sentences[1] AS claim,
         CASE WHEN l.toxic = 1 THEN 'REFUTES' WHEN l.quality = 1 THEN 'SUPPORTS'
              ELSE 'NOT ENOUGH INFO' END AS label,
         d.sentences,
         CASE WHEN len(d.sentences) = 0 THEN CAST([] AS BIGINT[][])
              ELSE flatten(list_transform(range((len(d.sentences) - 1) // 3 + 1), lambda j: list_filter(
                   [[3 * j], list_filter([3 * j + 1, 3 * j + 2], lambda i: i < len(d.sentences))],
                   lambda st: len(st) > 0))) END AS evidence_sets
  FROM doc_lines d JOIN labels l ON l.doc_id = d.doc_id
),
nested_sets AS (
  SELECT claim_id, claim, label AS word, sentences,
         unnest(evidence_sets) AS es, generate_subscripts(evidence_sets, 1) AS pos
  FROM nested
),
flat AS (
  SELECT claim_id, (pos - 1)::INTEGER AS set_pos, claim,
         array_to_string(list_transform(es, lambda i: sentences[i + 1]), ' ') AS evidence,
         {code3('word')} AS label
  FROM nested_sets
)"""

CORPUS = f"""
corpus AS (SELECT doc_id::BIGINT AS doc_id, {lines('text')} AS abstract FROM documents),
cites AS (
  SELECT DISTINCT item_id, text AS claim,
         ('0x' || substr(md5(concat_ws(':', 'cite', item_id::VARCHAR, j::VARCHAR)), 1, 8))::BIGINT
           % (SELECT count(*) FROM documents) AS doc_id
  FROM (SELECT item_id, text, unnest(range(CASE WHEN item_id % 2 = 0 THEN 5 ELSE {TB.CITED} END)) AS j FROM benchmark)
),
gold AS (
  SELECT c.item_id::BIGINT AS claim_id, c.doc_id::INTEGER AS set_pos, c.claim,
         k.abstract[('0x' || substr(md5(concat_ws(':', 'gold', c.item_id::VARCHAR, c.doc_id::VARCHAR)), 1, 8))::BIGINT
                    % len(k.abstract) + 1] AS evidence,
         (CASE WHEN c.item_id % 4 = 2 THEN 2 ELSE 0 END)::INTEGER AS label
  FROM cites c JOIN corpus k ON k.doc_id = c.doc_id
  WHERE c.item_id % 2 = 0 AND len(k.abstract) > 0
),
cited AS (
  SELECT c.item_id::BIGINT AS claim_id, c.claim, c.doc_id FROM cites c JOIN corpus k ON k.doc_id = c.doc_id
  WHERE c.item_id % 2 = 1 AND len(k.abstract) > 0
),
neutral AS (
  SELECT c.claim_id, c.doc_id::INTEGER AS set_pos, c.claim,
         k.abstract[(('0x' || substr(md5(concat_ws(':', '{RG.NEUTRAL_SEED}', c.claim_id::VARCHAR,
                                                   c.doc_id::VARCHAR)), 1, 8))::BIGINT
                     % len(k.abstract)) + 1] AS evidence,
         1::INTEGER AS label
  FROM cited c JOIN corpus k ON k.doc_id = c.doc_id
)"""

TEXT_PAIRS = """
text_pairs AS (
  SELECT u.conv_id::BIGINT AS claim_id, u.turn::INTEGER AS set_pos, u.text AS claim, a.text AS evidence,
         (u.conv_id % 3)::INTEGER AS label
  FROM conversations u JOIN conversations a ON a.conv_id = u.conv_id AND a.turn = u.turn + 1
  WHERE u.role = 'user' AND a.role = 'assistant'
)"""


def with_(*ctes: str) -> str:
    return "WITH " + ",".join(ctes) + "\n"


# ------------------------------------------------------------------ experiment pieces

def split_ctes(src: str, seed: int, m: int, label: str = "label") -> str:
    """ranked / fit / dev CTEs over ``src`` (needs claim_id, set_pos, label, diff)."""
    dev_cond = f"rank > {m}"
    return f"""
ranked AS (
  SELECT *, row_number() OVER (PARTITION BY {label} ORDER BY {order_key(seed)}, claim_id, set_pos)::INTEGER AS rank
  FROM {src}
),
fit AS (SELECT * FROM ranked WHERE rank <= {m}),
dev AS (SELECT * FROM ranked WHERE {dev_cond})"""


def proto_ctes(fit: str = "fit", label: str = "label", prefix: str = "", proto_id: str | None = None) -> str:
    pid = proto_id or label
    return f"""
{prefix}proto_x AS (
  SELECT {label} AS label, pos, avg(x) AS x, count(*) AS n
  FROM (SELECT {label}, unnest(diff) AS x, generate_subscripts(diff, 1) - 1 AS pos FROM {fit})
  GROUP BY {label}, pos
),
{prefix}protos AS (
  SELECT label::INTEGER AS label, max(n)::BIGINT AS n, list(x ORDER BY pos) AS centroid
  FROM {prefix}proto_x GROUP BY label
)"""


def packed_cte(protos: str = "protos", name: str = "packed", pid: str = "label") -> str:
    return f"""
{name} AS (
  SELECT list(struct_pack(pid := {pid}, label := label, centroid := centroid) ORDER BY {pid}) AS ps
  FROM {protos}
)"""


def flagship(seed: int = RG.SEED, m: int = RG.M) -> str:
    return with_(VEC_PAIRS, split_ctes("fpairs", seed, m), proto_ctes(), packed_cte(), f"""
scored AS (
  SELECT d.claim_id, d.set_pos, d.label AS truth, {argmax_label('d.diff', 'k.ps')} AS pred
  FROM dev d CROSS JOIN packed k
),
conf_counts AS (
  SELECT {letter3('truth')} AS y_truth, {letter3('pred')} AS y_pred, count(*) AS n FROM scored GROUP BY ALL
),
letters AS (SELECT unnest(['s', 'n', 'c']) AS l),
conf AS (
  SELECT t.l AS y_truth, p.l AS y_pred, coalesce(c.n, 0)::BIGINT AS n
  FROM letters t CROSS JOIN letters p
  LEFT JOIN conf_counts c ON c.y_truth = t.l AND c.y_pred = p.l
)""" + "," + F1_CTES)


F1_CTES = """
tp AS (SELECT y_truth AS label, n AS tp FROM conf WHERE y_truth = y_pred),
rs AS (SELECT y_truth AS label, sum(n) AS support FROM conf GROUP BY 1),
cs AS (SELECT y_pred AS label, sum(n) AS predicted FROM conf GROUP BY 1),
per AS (
  SELECT rs.label, coalesce(tp.tp, 0) AS tp, rs.support, cs.predicted,
         coalesce(CASE WHEN cs.predicted = 0 THEN NULL ELSE coalesce(tp.tp, 0)::DOUBLE / cs.predicted END, 0.0) AS precision,
         coalesce(CASE WHEN rs.support = 0 THEN NULL ELSE coalesce(tp.tp, 0)::DOUBLE / rs.support END, 0.0) AS recall,
         coalesce(CASE WHEN 2 * coalesce(tp.tp, 0) + (cs.predicted - coalesce(tp.tp, 0)) + (rs.support - coalesce(tp.tp, 0)) = 0
                       THEN NULL
                       ELSE 2.0 * coalesce(tp.tp, 0) / (2 * coalesce(tp.tp, 0) + (cs.predicted - coalesce(tp.tp, 0))
                                                         + (rs.support - coalesce(tp.tp, 0))) END, 0.0) AS f1
  FROM rs JOIN cs ON cs.label = rs.label LEFT JOIN tp ON tp.label = rs.label
)"""


def nested_experiment(seed: int = RG.SEED, m: int = RG.M, d: int = RG.HASH_D) -> str:
    """Entry A on texts, ending in scored rows with dataset_index and letters."""
    return with_(NESTED, f"""
npairs AS (
  SELECT *, {vabsdiff('evidence_vec', 'claim_vec')} AS diff
  FROM (SELECT *, {l2n('cv')} AS claim_vec, {l2n('ev')} AS evidence_vec
        FROM (SELECT *, {hash_vec('claim', d)} AS cv, {hash_vec('evidence', d)} AS ev FROM flat))
)""", split_ctes("npairs", seed, m), proto_ctes(), packed_cte(), f"""
dev_sizes AS (SELECT label, count(*) AS n FROM dev GROUP BY label),
offsets AS (
  SELECT label, coalesce(sum(n) OVER (ORDER BY label ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS off
  FROM dev_sizes
),
scored AS (
  SELECT (o.off + d.rank - {m} - 1)::BIGINT AS dataset_index, d.claim, d.evidence,
         {letter3('d.label')} AS y_truth, {letter3(argmax_label('d.diff', 'k.ps'))} AS y_pred
  FROM dev d JOIN offsets o ON o.label = d.label CROSS JOIN packed k
),
conf_counts AS (SELECT y_truth, y_pred, count(*) AS n FROM scored GROUP BY ALL),
letters AS (SELECT unnest(['s', 'n', 'c']) AS l),
conf AS (
  SELECT t.l AS y_truth, p.l AS y_pred, coalesce(c.n, 0)::BIGINT AS n
  FROM letters t CROSS JOIN letters p
  LEFT JOIN conf_counts c ON c.y_truth = t.l AND c.y_pred = p.l
),""" + F1_CTES)


def sweep_sql(seeds=REFERENCE_SEEDS, shots=REFERENCE_SHOTS, src_ctes: str = VEC_PAIRS, src: str = "fpairs",
              absolute: bool = True, split: str = "dev", p: str = "", head: bool = True) -> str:
    """CTEs ending in ``{p}conf (seed, m, y_truth, y_pred, n)`` and
    ``{p}csummary`` for the grid; ``p`` prefixes every CTE name so several
    sweeps can share one statement (``head=False`` drops the shared views)."""
    seeds_l = ", ".join(str(s) for s in seeds)
    shots_l = ", ".join(str(m) for m in shots)
    diff_src = src
    extra = ""
    if not absolute:
        extra = f"""
{p}spairs AS (SELECT * EXCLUDE (diff), {vsigned('evidence_vec', 'claim_vec')} AS diff FROM {src}),"""
        diff_src = f"{p}spairs"
    member = "r.rank <= g.m" if split == "fit" else "r.rank > g.m"
    body = f"""{extra}
{p}seeds AS (SELECT unnest([{seeds_l}])::INTEGER AS seed),
{p}shots AS (SELECT unnest([{shots_l}])::INTEGER AS m),
{p}ranked AS (
  SELECT s.seed, x.claim_id, x.set_pos, x.label,
         row_number() OVER (PARTITION BY s.seed, x.label ORDER BY {order_key('s.seed', 'x.claim_id', 'x.set_pos')},
                            x.claim_id, x.set_pos) AS rank
  FROM {diff_src} x CROSS JOIN {p}seeds s
),
{p}cfit AS (SELECT r.seed, g.m, r.claim_id, r.set_pos, r.label FROM {p}ranked r JOIN {p}shots g ON r.rank <= g.m),
{p}cproto_x AS (
  SELECT seed, m, label, pos, avg(x) AS x FROM (
    SELECT f.seed, f.m, f.label, unnest(v.diff) AS x, generate_subscripts(v.diff, 1) AS pos
    FROM {p}cfit f JOIN {diff_src} v ON v.claim_id = f.claim_id AND v.set_pos = f.set_pos)
  GROUP BY ALL
),
{p}cprotos AS (SELECT seed, m, label, list(x ORDER BY pos) AS centroid FROM {p}cproto_x GROUP BY ALL),
{p}cpacked AS (
  SELECT seed, m, list(struct_pack(pid := label, label := label, centroid := centroid) ORDER BY label) AS ps
  FROM {p}cprotos GROUP BY seed, m
),
{p}cmember AS (SELECT r.seed, g.m, r.claim_id, r.set_pos, r.label FROM {p}ranked r JOIN {p}shots g ON {member}),
{p}cscored AS (
  SELECT d.seed, d.m, d.label AS truth, {argmax_label('v.diff', 'k.ps')} AS pred
  FROM {p}cmember d JOIN {diff_src} v ON v.claim_id = d.claim_id AND v.set_pos = d.set_pos
  JOIN {p}cpacked k ON k.seed = d.seed AND k.m = d.m
),
""" + metrics_ctes(p)
    if head:
        return with_(src_ctes + "," + body)
    return body


def metrics_ctes(p: str = "") -> str:
    """From ``{p}cscored (seed, m, truth, pred)``: counts, confusion and summary of every cell."""
    return f"""
{p}ccounts AS (
  SELECT seed, m, {letter3('truth')} AS y_truth, {letter3('pred')} AS y_pred, count(*) AS n
  FROM {p}cscored GROUP BY ALL
),
{p}letters AS (SELECT unnest(['s', 'n', 'c']) AS l),
{p}cells AS (SELECT DISTINCT seed, m FROM {p}ccounts),
{p}conf AS (
  SELECT c.seed, c.m, t.l AS y_truth, q.l AS y_pred, coalesce(x.n, 0)::BIGINT AS n
  FROM {p}cells c CROSS JOIN {p}letters t CROSS JOIN {p}letters q
  LEFT JOIN {p}ccounts x ON x.seed = c.seed AND x.m = c.m AND x.y_truth = t.l AND x.y_pred = q.l
),
{p}ctp AS (SELECT seed, m, y_truth AS label, n AS tp FROM {p}conf WHERE y_truth = y_pred),
{p}crs AS (SELECT seed, m, y_truth AS label, sum(n) AS support FROM {p}conf GROUP BY ALL),
{p}ccs AS (SELECT seed, m, y_pred AS label, sum(n) AS predicted FROM {p}conf GROUP BY ALL),
{p}cper AS (
  SELECT crs.seed, crs.m, crs.label, crs.support, ccs.predicted,
         coalesce(CASE WHEN 2 * ctp.tp + (ccs.predicted - ctp.tp) + (crs.support - ctp.tp) = 0 THEN NULL
                       ELSE 2.0 * ctp.tp / (2 * ctp.tp + (ccs.predicted - ctp.tp) + (crs.support - ctp.tp)) END, 0.0) AS f1
  FROM {p}crs crs JOIN {p}ccs ccs USING (seed, m, label) JOIN {p}ctp ctp USING (seed, m, label)
),
{p}csummary AS (
  SELECT a.seed, a.m, a.accuracy, f.f1_s, f.f1_n, f.f1_c, f.f1_macro FROM (
    SELECT seed, m, round(sum(CASE WHEN y_truth = y_pred THEN n ELSE 0 END)::DOUBLE / sum(n), 4) AS accuracy
    FROM {p}conf GROUP BY seed, m) a
  JOIN (
    SELECT seed, m,
           round(max(CASE WHEN label = 's' THEN f1 END), 4) AS f1_s,
           round(max(CASE WHEN label = 'n' THEN f1 END), 4) AS f1_n,
           round(max(CASE WHEN label = 'c' THEN f1 END), 4) AS f1_c,
           round(avg(CASE WHEN support > 0 OR predicted > 0 THEN f1 END), 4) AS f1_macro
    FROM {p}cper GROUP BY seed, m) f USING (seed, m)
)"""


def fitted_ctes(seeds, shots, kind: str, steps: int = 300, p: str = "") -> str:
    """The optimum of a penalised linear fit for every cell, by accelerated
    gradient steps in the dual: ``{p}weights (seed, m, w)``, a list of weights
    per class, each a sum of the fit rows.  Independent of the library's
    closed forms: only inner products of fit rows are used.

    ``kind``: ``softmax`` (the logistic regression; the vector gets a one) or
    ``ridge`` (the map to the classes' unit vectors)."""
    soft = kind == "softmax"
    vec = "list_append(v.diff, 1.0)" if soft else "v.diff"
    # the size of a step and the strength of the penalty; both objectives are strictly convex
    smooth, strong = (f"0.5 * max(k[i]) + {L2}", f"{L2}") if soft else (f"sum(k[i]) + {RIDGE}", f"{RIDGE}")
    if soft:
        slope = lambda k: f"((e{k} / (e0 + e1 + e2) - (label = {k})::INTEGER) / n + {L2} * y[{k + 1}][i])"
    else:
        slope = lambda k: f"(z{k} + {RIDGE} * y[{k + 1}][i] - (label = {k})::INTEGER)"
    new = ", ".join(f"y[{k + 1}][i] - eta * {slope(k)} AS n{k}" for k in range(3))
    return f"""
{p}fseeds AS (SELECT unnest([{", ".join(map(str, seeds))}])::INTEGER AS seed),
{p}fshots AS (SELECT unnest([{", ".join(map(str, shots))}])::INTEGER AS m),
{p}franked AS MATERIALIZED (
  SELECT s.seed, x.claim_id, x.set_pos, x.label,
         row_number() OVER (PARTITION BY s.seed, x.label ORDER BY {order_key('s.seed', 'x.claim_id', 'x.set_pos')},
                            x.claim_id, x.set_pos) AS rank
  FROM fpairs x CROSS JOIN {p}fseeds s
),
{p}frows AS MATERIALIZED (
  SELECT r.seed, g.m, r.label, {vec} AS x, row_number() OVER (PARTITION BY r.seed, g.m ORDER BY r.rank, r.label) AS i
  FROM {p}franked r JOIN {p}fshots g ON r.rank <= g.m JOIN fpairs v ON v.claim_id = r.claim_id AND v.set_pos = r.set_pos
),
{p}gram AS MATERIALIZED (
  SELECT a.seed, a.m, a.i, a.label, list(list_inner_product(a.x, b.x) ORDER BY b.i) AS k
  FROM {p}frows a JOIN {p}frows b ON a.seed = b.seed AND a.m = b.m GROUP BY a.seed, a.m, a.i, a.label
),
{p}fstep AS MATERIALIZED (
  SELECT seed, m, count(*) AS n, 1 / ({smooth}) AS eta,
         (1 - sqrt({strong} / ({smooth}))) / (1 + sqrt({strong} / ({smooth}))) AS beta
  FROM {p}gram GROUP BY seed, m
),
{p}fit AS (
  SELECT 0 AS it, seed, m, [z, z, z] AS a, [z, z, z] AS y FROM (
    SELECT seed, m, list_transform(range(n), lambda j: 0.0::DOUBLE) AS z FROM {p}fstep)
  UNION ALL
  SELECT it + 1, seed, m, [list(n0 ORDER BY i), list(n1 ORDER BY i), list(n2 ORDER BY i)],
         [list(n0 + beta * (n0 - o0) ORDER BY i), list(n1 + beta * (n1 - o1) ORDER BY i), list(n2 + beta * (n2 - o2) ORDER BY i)]
  FROM (
    SELECT it, seed, m, i, beta, a[1][i] AS o0, a[2][i] AS o1, a[3][i] AS o2, {new} FROM (
      SELECT *, exp(z0 - greatest(z0, z1, z2)) AS e0, exp(z1 - greatest(z0, z1, z2)) AS e1, exp(z2 - greatest(z0, z1, z2)) AS e2 FROM (
        SELECT f.it, f.seed, f.m, f.a, f.y, g.i, g.label, s.n, s.eta, s.beta, list_inner_product(g.k, f.y[1]) AS z0,
               list_inner_product(g.k, f.y[2]) AS z1, list_inner_product(g.k, f.y[3]) AS z2
        FROM {p}fit f JOIN {p}gram g ON g.seed = f.seed AND g.m = f.m JOIN {p}fstep s ON s.seed = f.seed AND s.m = f.m
        WHERE f.it < {steps})))
  GROUP BY it, seed, m
),
{p}wpos AS (
  SELECT seed, m, pos, sum(a0 * x) AS w0, sum(a1 * x) AS w1, sum(a2 * x) AS w2 FROM (
    SELECT r.seed, r.m, f.a[1][r.i] AS a0, f.a[2][r.i] AS a1, f.a[3][r.i] AS a2, unnest(r.x) AS x, generate_subscripts(r.x, 1) AS pos
    FROM {p}frows r JOIN {p}fit f ON f.seed = r.seed AND f.m = r.m AND f.it = {steps})
  GROUP BY seed, m, pos
),
{p}weights AS MATERIALIZED (
  SELECT seed, m, [list(w0 ORDER BY pos), list(w1 ORDER BY pos), list(w2 ORDER BY pos)] AS w FROM {p}wpos GROUP BY seed, m
),
{p}fz AS MATERIALIZED (
  SELECT r.seed, g.m, r.claim_id, r.set_pos, r.label, r.rank, list_transform(k.w, lambda w: list_inner_product({vec}, w)) AS z
  FROM {p}franked r CROSS JOIN {p}fshots g JOIN fpairs v ON v.claim_id = r.claim_id AND v.set_pos = r.set_pos
  JOIN {p}weights k ON k.seed = r.seed AND k.m = g.m
)"""


def with_recursive(*ctes: str) -> str:
    return "WITH RECURSIVE " + ",".join(ctes) + "\n"


def softmax_sql(seeds, shots) -> str:
    return with_recursive(VEC_PAIRS.replace("fpairs AS (", "fpairs AS MATERIALIZED ("), fitted_ctes(seeds, shots, "softmax"), """
cscored AS (
  SELECT seed, m, claim_id, set_pos, label AS truth, (list_position(z, list_max(z)) - 1)::INTEGER AS pred,
         1 / list_sum(list_transform(z, lambda x: exp(x - list_max(z)))) AS prob
  FROM fz WHERE rank > m
),""" + metrics_ctes())


def pair_metric(expr_fn) -> str:
    return with_(VEC_PAIRS) + f"SELECT pair_id, round({expr_fn('claim_vec', 'evidence_vec')}, 4) AS value FROM vec_pairs"


def _cos(a, b):
    return (f"(CASE WHEN {vnorm(a)} * {vnorm(b)} = 0 THEN 'nan'::DOUBLE "
            f"ELSE {vdot(a, b)} / ({vnorm(a)} * {vnorm(b)}) END)")


def _theta(a, b):
    return f"(acos(least(1.0, greatest(-1.0, {_cos(a, b)}))) + radians(10))"


def _triangle(a, b):
    return f"({vnorm(a)} * {vnorm(b)} * sin(radians({_theta(a, b)})) / 2.0)"


def _magdiff(a, b):
    return f"abs({vnorm(a)} - {vnorm(b)})"


def _sector(a, b):
    return f"(pi() * pow({ved(a, b)} + {_magdiff(a, b)}, 2.0) * {_theta(a, b)} / 360.0)"


def build() -> dict[str, str]:
    q: dict[str, str] = {}
    # ---------------- sources
    q["scan_claims"] = with_(NESTED) + """SELECT claim_id, claim, label, len(sentences)::INTEGER AS n_sentences,
        len(evidence_sets)::INTEGER AS n_sets FROM nested"""
    q["flatten_pairs"] = with_(NESTED) + "SELECT claim_id, set_pos, claim, evidence, label FROM flat"
    q["flatten_single"] = with_(NESTED) + """SELECT claim_id, (pos - 1)::INTEGER AS set_pos, claim,
        array_to_string(list_transform(es, lambda i: sentences[i + 1]), ' ') AS evidence, """ + code3("word") + """ AS label
        FROM nested_sets WHERE len(es) = 1"""
    q["flatten_first_evidence"] = with_(NESTED) + f"""SELECT claim_id, 0::INTEGER AS set_pos,
        {norm_claim('claim')} AS claim, {norm_evidence('sentences[evidence_sets[1][1] + 1]')} AS evidence,
        {code3('label')} AS label FROM nested"""
    q["corpus_dedup"] = with_(CORPUS, f"""
versions AS (
  SELECT doc_id, abstract, 0 AS version FROM corpus
  UNION ALL
  SELECT c.doc_id, list_transform(c.abstract, lambda s: {norm_evidence('s')}), 1 AS version
  FROM corpus c JOIN documents d ON d.doc_id = c.doc_id WHERE d.lang = 'en'
)""") + """SELECT doc_id, version::INTEGER AS version, len(abstract)::INTEGER AS n_sentences,
        array_to_string(abstract, chr(10)) AS abstract_text
        FROM (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY version DESC) AS rn FROM versions) WHERE rn = 1"""
    q["corpus_pairs_gold"] = with_(CORPUS) + "SELECT * FROM gold"
    q["corpus_pairs_neutral"] = with_(CORPUS) + "SELECT * FROM neutral"
    q["corpus_pairs"] = with_(CORPUS) + "SELECT * FROM gold UNION ALL SELECT * FROM neutral"
    # ---------------- projections / text
    q["encode_label"] = with_(NESTED) + f"SELECT claim_id, label AS label_word, {code3('label')} AS code FROM nested"
    q["decode_three"] = with_(NESTED) + f"SELECT claim_id, set_pos, label, {letter3('label')} AS letter FROM flat"
    q["decode_binary"] = with_(NESTED) + f"SELECT claim_id, set_pos, label, {letter2('label')} AS letter FROM flat"
    q["label_to_binary"] = with_(NESTED) + """SELECT claim_id, set_pos, label,
        (CASE WHEN label = 0 THEN 0 ELSE 1 END)::INTEGER AS blabel FROM flat"""
    q["union_classes"] = with_(NESTED) + """SELECT claim_id, set_pos, label FROM flat WHERE label = 0
        UNION ALL SELECT claim_id, set_pos, label FROM flat WHERE label = 1
        UNION ALL SELECT claim_id, set_pos, label FROM flat WHERE label = 2"""
    q["clean_brackets"] = f"SELECT doc_id, {clean(bracketed('text'))} AS text FROM documents"
    q["normalize_text"] = with_(TEXT_PAIRS) + f"""SELECT claim_id, set_pos, {norm_claim(bracketed('claim'))} AS claim,
        {norm_evidence(bracketed('evidence'))} AS evidence FROM text_pairs"""
    q["merge_sentences"] = with_(CORPUS) + "SELECT doc_id, array_to_string(abstract, ' ') AS merged FROM corpus"
    # ---------------- sampling
    rank_vp = lambda seed_expr="123", part="label", src="vec_pairs": (
        f"row_number() OVER (PARTITION BY {part} ORDER BY {order_key(seed_expr)}, claim_id, set_pos)::INTEGER")
    q["fit_sample"] = with_(VEC_PAIRS) + f"""SELECT claim_id, set_pos, label, {RG.SEED} AS seed, rank FROM (
        SELECT claim_id, set_pos, label, {rank_vp(RG.SEED)} AS rank FROM vec_pairs) WHERE rank <= {RG.M}"""
    q["dev_complement"] = with_(VEC_PAIRS) + f"""SELECT claim_id, set_pos, label, {RG.SEED} AS seed FROM (
        SELECT claim_id, set_pos, label, {rank_vp(RG.SEED)} AS rank FROM vec_pairs) WHERE rank > {RG.M}"""
    caps = RG.BINARY_CAPS
    q["cap_per_class"] = with_(VEC_PAIRS) + f"""SELECT claim_id, set_pos, label, {RG.SEED} AS seed, rank FROM (
        SELECT claim_id, set_pos, label, {rank_vp(RG.SEED)} AS rank FROM vec_pairs)
        WHERE rank <= CASE label WHEN 0 THEN {caps[0]} WHEN 1 THEN {caps[1]} WHEN 2 THEN {caps[2]} ELSE 0 END"""
    q["dev_capped"] = with_(NESTED) + f"""SELECT claim_id, set_pos, label, {RG.SEED} AS seed, rank FROM (
        SELECT claim_id, set_pos, label, {rank_vp(RG.SEED)} AS rank FROM flat) WHERE rank <= {RG.DEV_CAP}"""
    binary = with_(NESTED, f"""
bflat AS (SELECT claim_id, set_pos, label, (CASE WHEN label = 0 THEN 0 ELSE 1 END)::INTEGER AS blabel FROM flat),
bsplit AS (
  SELECT claim_id, set_pos, label, blabel, {RG.SEED} AS seed,
         CASE WHEN rank <= {RG.M} THEN rank END AS rank,
         CASE WHEN rank <= {RG.M} THEN 'fit' ELSE 'dev' END AS split
  FROM (SELECT *, {rank_vp(RG.SEED, 'blabel')} AS rank FROM bflat)
)""")
    q["binary_split"] = binary + "SELECT * FROM bsplit"
    q["binary_split_capped"] = with_(VEC_PAIRS, f"""
cappool AS (
  SELECT claim_id, set_pos, label, (CASE WHEN label = 0 THEN 0 ELSE 1 END)::INTEGER AS blabel FROM (
    SELECT claim_id, set_pos, label, {rank_vp(RG.SEED)} AS rank FROM vec_pairs)
  WHERE rank <= CASE label WHEN 0 THEN {caps[0]} WHEN 1 THEN {caps[1]} WHEN 2 THEN {caps[2]} END
)""") + f"""SELECT claim_id, set_pos, label, blabel, {RG.SEED} AS seed, CASE WHEN rank <= {RG.M} THEN rank END AS rank,
        CASE WHEN rank <= {RG.M} THEN 'fit' ELSE 'dev' END AS split
        FROM (SELECT *, {rank_vp(RG.SEED, 'blabel')} AS rank FROM cappool)"""
    q["split_counts"] = binary + "SELECT split, blabel AS label, count(*) AS n FROM bsplit GROUP BY ALL"
    shots = REFERENCE_SHOTS
    nxt = list(zip(shots, shots[1:] + [shots[-1]]))
    grid = ", ".join(f"({a}, {b})" for a, b in nxt)
    seeds_l = ", ".join(str(s) for s in RG.SMALL_SEEDS)
    q["prefix_property"] = with_(VEC_PAIRS) + f"""SELECT r.seed, r.label, g.m,
        count(*) AS n_fit, sum(CASE WHEN r.rank <= g.m_next THEN 1 ELSE 0 END)::BIGINT AS n_in_next
        FROM (SELECT s.seed, v.label, row_number() OVER (PARTITION BY s.seed, v.label
                ORDER BY {order_key('s.seed', 'v.claim_id', 'v.set_pos')}, v.claim_id, v.set_pos) AS rank
              FROM vec_pairs v CROSS JOIN (SELECT unnest([{seeds_l}])::INTEGER AS seed) s) r
        JOIN (VALUES {grid}) g(m, m_next) ON r.rank <= g.m
        GROUP BY r.seed, r.label, g.m"""
    # ---------------- vectors
    d_abs = vabsdiff("evidence_vec", "claim_vec")
    d_sig = vsigned("evidence_vec", "claim_vec")
    q["pair_diff_abs"] = with_(VEC_PAIRS) + f"""SELECT pair_id, round(list_sum(d), 4) AS diff_sum,
        round({vnorm('d')}, 4) AS diff_norm, round(list_max(d), 4) AS diff_max
        FROM (SELECT pair_id, {d_abs} AS d FROM vec_pairs)"""
    q["pair_diff_signed"] = with_(VEC_PAIRS) + f"""SELECT pair_id, round(list_sum(d), 4) AS diff_sum,
        round({vnorm('d')}, 4) AS diff_norm, round(list_min(d), 4) AS diff_min
        FROM (SELECT pair_id, {d_sig} AS d FROM vec_pairs)"""
    q["sim_euclidean"] = pair_metric(lambda a, b: f"1.0 - {ved(a, b)}")
    q["sim_cosine"] = pair_metric(_cos)
    q["dist_euclidean"] = pair_metric(ved)
    q["vec_norm"] = with_(VEC_PAIRS) + f"""SELECT pair_id, round({vnorm('claim_vec')}, 4) AS claim_norm,
        round({vnorm('evidence_vec')}, 4) AS evidence_norm FROM vec_pairs"""
    q["vec_dot"] = pair_metric(vdot)
    q["vec_theta"] = pair_metric(_theta)
    q["vec_triangle"] = pair_metric(_triangle)
    q["vec_magdiff"] = pair_metric(_magdiff)
    q["vec_sector"] = pair_metric(_sector)
    q["dist_tsss"] = pair_metric(lambda a, b: f"({_triangle(a, b)} * {_sector(a, b)})")
    d = RG.HASH_D
    q["encode_hashing"] = with_(TEXT_PAIRS) + f"""SELECT claim_id, set_pos,
        round(list_sum(cv), 4) AS claim_sum, round(list_sum(ev), 4) AS evidence_sum,
        len(list_filter(cv, lambda x: x <> 0))::BIGINT AS claim_nnz,
        len(list_filter(ev, lambda x: x <> 0))::BIGINT AS evidence_nnz,
        round({vdot('cv', 'ev')}, 4) AS dot
        FROM (SELECT claim_id, set_pos, {l2n('c0')} AS cv, {l2n('e0')} AS ev
              FROM (SELECT *, {hash_vec('claim', d)} AS c0, {hash_vec('evidence', d)} AS e0 FROM text_pairs))"""
    q["pool_tokens"] = with_(TEXT_PAIRS, f"""
vocab AS (SELECT vec_id AS vocab_id, list_transform(embedding, lambda x: x::DOUBLE) AS vec FROM embeddings),
vsize AS (SELECT count(*) AS n FROM embeddings),
toks AS (
  SELECT text_key, hv % (SELECT n FROM vsize) AS vocab_id, pos FROM (
    SELECT text_key, unnest(b) AS hv, generate_subscripts(b, 1) AS pos FROM (
      SELECT concat_ws(':', claim_id::VARCHAR, set_pos::VARCHAR) AS text_key,
             list_transform(list_filter(regexp_split_to_array(lower(claim), {TOKEN_SPLIT}), lambda t: t <> ''),
                            lambda t: ('0x' || substr(md5(t), 1, 8))::BIGINT) AS b
      FROM text_pairs))
),
tcounts AS (SELECT text_key, vocab_id, count(*) AS n FROM toks GROUP BY ALL),
tv AS (SELECT c.text_key, c.n, v.vec FROM tcounts c JOIN vocab v ON v.vocab_id = c.vocab_id),
px AS (SELECT text_key, unnest(vec) AS x, generate_subscripts(vec, 1) AS pos, n FROM tv),
pmean AS (SELECT text_key, 'mean' AS mode, list(x ORDER BY pos) AS vec FROM (
  SELECT text_key, pos, sum(x * n) / sum(n) AS x FROM px GROUP BY ALL) GROUP BY text_key),
pmax AS (SELECT text_key, 'max' AS mode, list(x ORDER BY pos) AS vec FROM (
  SELECT text_key, pos, max(x) AS x FROM px GROUP BY ALL) GROUP BY text_key),
pcls AS (SELECT f.text_key, 'cls' AS mode, v.vec FROM (
  SELECT text_key, arg_min(vocab_id, pos) AS vocab_id FROM toks GROUP BY text_key) f
  JOIN vocab v ON v.vocab_id = f.vocab_id),
pooled AS (SELECT * FROM pmean UNION ALL SELECT * FROM pmax UNION ALL SELECT * FROM pcls)""") + f"""
SELECT text_key, mode, round(list_sum(vec), 4) AS vec_sum, round({vnorm('vec')}, 4) AS vec_norm FROM pooled"""
    q["pool_token_vectors"] = q["pool_tokens"]
    # ---------------- prototypes
    q["prototypes"] = with_(VEC_PAIRS, split_ctes("fpairs", RG.SEED, RG.M), proto_ctes()) + """
SELECT label, n, (generate_subscripts(centroid, 1) - 1)::INTEGER AS pos, round(unnest(centroid), 4) AS value FROM protos"""
    q["baseline_logreg"] = softmax_sql([RG.SEED], [RG.M]) + "SELECT claim_id, set_pos, truth, pred, round(prob, 4) AS prob FROM cscored"
    # runs differ in their start only, and the optimum is one
    q["sweep_baseline"] = softmax_sql(RG.SMALL_SEEDS, RG.SMALL_SHOTS) + f"""
SELECT seed, m, run::INTEGER AS run, y_truth, y_pred, n FROM conf CROSS JOIN (SELECT unnest({RG.BASELINE_RUNS}) AS run)"""
    q["predict_three"] = flagship() + "SELECT claim_id, set_pos, truth, pred FROM scored"
    two = with_(VEC_PAIRS, """
bpairs AS (SELECT * EXCLUDE (label), (CASE WHEN label = 0 THEN 0 ELSE 1 END)::INTEGER AS label FROM fpairs)""",
                split_ctes("bpairs", RG.SEED, RG.M), proto_ctes(), packed_cte(), f"""
scored AS (
  SELECT d.claim_id, d.set_pos, d.label AS truth, {argmax_label('d.diff', 'k.ps')} AS pred FROM dev d CROSS JOIN packed k
),
letters AS (SELECT unnest(['s', 'not']) AS l),
conf_counts AS (SELECT {letter2('truth')} AS y_truth, {letter2('pred')} AS y_pred, count(*) AS n FROM scored GROUP BY ALL),
conf AS (
  SELECT t.l AS y_truth, p.l AS y_pred, coalesce(c.n, 0)::BIGINT AS n
  FROM letters t CROSS JOIN letters p LEFT JOIN conf_counts c ON c.y_truth = t.l AND c.y_pred = p.l
),""" + F1_CTES)
    q["predict_binary"] = two + "SELECT claim_id, set_pos, truth, pred FROM scored"
    q["binary_accuracy"] = two + "SELECT round(avg((truth = pred)::INTEGER::DOUBLE), 4) AS accuracy, count(*) AS n FROM scored"
    q["binary_confusion"] = two + "SELECT y_truth, y_pred, n FROM conf"
    q["binary_f1"] = two + """SELECT label, round(precision, 4) AS precision, round(recall, 4) AS recall,
        round(f1, 4) AS f1, support::BIGINT AS support FROM per"""
    q["corpus_experiment"] = with_(NESTED, CORPUS, f"""
cpairs AS (SELECT * FROM gold UNION ALL SELECT * FROM neutral),
fit AS (
  SELECT label, {vabsdiff('ev', 'cv')} AS diff FROM (
    SELECT label, {l2n('c0')} AS cv, {l2n('e0')} AS ev FROM (
      SELECT label, {hash_vec('claim', RG.HASH_D)} AS c0, {hash_vec('evidence', RG.HASH_D)} AS e0 FROM (
        SELECT *, {rank_vp(RG.SEED)} AS rank FROM flat) WHERE rank <= {RG.M}))
),
dev AS (
  SELECT claim_id, set_pos, label, {vabsdiff('ev', 'cv')} AS diff FROM (
    SELECT claim_id, set_pos, label, {l2n('c0')} AS cv, {l2n('e0')} AS ev FROM (
      SELECT claim_id, set_pos, label, {hash_vec('claim', RG.HASH_D)} AS c0, {hash_vec('evidence', RG.HASH_D)} AS e0 FROM (
        SELECT *, {rank_vp(RG.SEED)} AS rank FROM cpairs) WHERE rank <= {RG.DEV_CAP}))
)""", proto_ctes(), packed_cte()) + f"""
SELECT d.claim_id, d.set_pos, d.label AS truth, {argmax_label('d.diff', 'k.ps')} AS pred FROM dev d CROSS JOIN packed k"""
    counts = ", ".join(f"len({{0}}) - len(replace({{0}}, '{c}', ''))" for c in RG.TEXT_FEATURES)
    feats = f"list_transform([{counts}, len({{0}})], lambda x: x::DOUBLE / 100)"
    q["encode_batch_model"] = with_(TEXT_PAIRS) + f"""SELECT claim_id, set_pos, round(list_sum(cv), 4) AS claim_sum,
        round(list_sum(ev), 4) AS evidence_sum, round({vdot('cv', 'ev')}, 4) AS dot
        FROM (SELECT claim_id, set_pos, {feats.format('claim')} AS cv, {feats.format('evidence')} AS ev FROM text_pairs)"""
    q["encode_store"] = q["encode_batch_model"]
    q["encode_fills"] = with_(TEXT_PAIRS) + """
SELECT 1::INTEGER AS fill, count(DISTINCT claim) AS encoded FROM text_pairs
UNION ALL SELECT 2, count(DISTINCT evidence) FROM text_pairs WHERE evidence NOT IN (SELECT claim FROM text_pairs WHERE claim IS NOT NULL)
UNION ALL SELECT 3, 0"""
    multi = []
    for i, s in enumerate((RG.SEED, RG.SEED + 1)):
        multi.append(f"""
r{i} AS (SELECT *, row_number() OVER (PARTITION BY label ORDER BY {order_key(s)}, claim_id, set_pos) AS rank FROM fpairs),
f{i} AS (SELECT * FROM r{i} WHERE rank <= {RG.M})""" + "," + proto_ctes(f"f{i}", prefix=f"s{i}_"))
    # materialised, and the similarities bound once: cheap whatever the planner makes of it
    q["predict_multi_proto"] = with_(VEC_PAIRS.replace("fpairs AS (", "fpairs AS MATERIALIZED ("), *multi, """
allp AS (SELECT label + 0 AS pid, label, centroid FROM s0_protos UNION ALL SELECT label + 3 AS pid, label, centroid FROM s1_protos)""",
                                     packed_cte("allp", pid="pid").replace("packed AS (", "packed AS MATERIALIZED ("), f"""
sims AS MATERIALIZED (
  SELECT v.claim_id, v.set_pos, v.label AS truth, k.ps, list_transform(k.ps, lambda q: 1.0 - {ved('v.diff', 'q.centroid')}) AS s
  FROM fpairs v CROSS JOIN packed k
)""") + "SELECT claim_id, set_pos, truth, (ps[list_position(s, list_max(s))]).label AS pred FROM sims"
    # ---------------- evaluation
    q["accuracy"] = flagship() + "SELECT round(avg((truth = pred)::INTEGER::DOUBLE), 4) AS accuracy, count(*) AS n FROM scored"
    q["confusion"] = flagship() + "SELECT y_truth, y_pred, n FROM conf"
    q["confusion_wide"] = flagship() + "SELECT y_truth, " + ", ".join(
        f"sum(CASE WHEN y_pred = '{c}' THEN n ELSE 0 END)::BIGINT AS {c}" for c in "snc") + " FROM conf GROUP BY y_truth"
    cap = " ".join(f"WHEN {k} THEN {v}" for k, v in RG.SMALL_CAPS.items())
    q["experiment_capped"] = with_(VEC_PAIRS, split_ctes("fpairs", RG.SEED, RG.M), proto_ctes(), packed_cte(), f"""
pool AS (SELECT * FROM dev WHERE rank <= (CASE label {cap} END)),
offs AS (
  SELECT label, coalesce(sum(n) OVER (ORDER BY label ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS off
  FROM (SELECT label, count(*) AS n FROM pool GROUP BY label)
)""") + f"""SELECT d.claim_id, d.set_pos, (o.off + d.rank - {RG.M} - 1)::BIGINT AS dataset_index, d.label AS truth,
        {argmax_label('d.diff', 'k.ps')} AS pred FROM pool d JOIN offs o ON o.label = d.label CROSS JOIN packed k"""
    q["f1_per_class"] = flagship() + """SELECT label, round(precision, 4) AS precision, round(recall, 4) AS recall,
        round(f1, 4) AS f1, support::BIGINT AS support FROM per"""
    q["f1_macro"] = flagship() + "SELECT round(avg(f1), 4) AS f1_macro FROM per WHERE support > 0 OR predicted > 0"
    q["f1_observed"] = nested_experiment() + "SELECT label, round(f1, 4) AS f1 FROM per WHERE support > 0 OR predicted > 0"
    q["errors_wrong"] = nested_experiment() + "SELECT dataset_index, claim, evidence, y_truth, y_pred FROM scored WHERE y_truth <> y_pred"
    q["errors_correct"] = nested_experiment() + "SELECT dataset_index, claim, evidence, y_truth, y_pred FROM scored WHERE y_truth = y_pred"
    q["error_sink"] = nested_experiment() + "SELECT dataset_index, claim, evidence, y_truth, y_pred, y_truth = y_pred AS is_correct FROM scored"
    q["accuracy_half_even"] = sweep_sql(RG.SMALL_SEEDS, RG.SMALL_SHOTS) + """
SELECT seed, m, round_even(sum(CASE WHEN y_truth = y_pred THEN n ELSE 0 END) * 100 / sum(n), 0)::INTEGER AS percent FROM conf GROUP BY seed, m"""
    # ---------------- sweep
    q["sweep"] = sweep_sql() + "SELECT seed, m, y_truth, y_pred, n FROM conf"
    grids = [sweep_sql(RG.SMALL_SEEDS, RG.SMALL_SHOTS, absolute=a, p=p, head=False) for p, a in (("x", True), ("y", False))]
    q["sweep_encoders"] = with_(VEC_PAIRS + "," + ",".join(grids)) + """SELECT 'absolute' AS encoder, seed, m, y_truth, y_pred, n FROM xconf
        UNION ALL SELECT 'signed' AS encoder, seed, m, y_truth, y_pred, n FROM yconf"""
    q["sweep_summary"] = sweep_sql() + "SELECT * FROM csummary"
    return q


def drift_sql(seed: int, steps, max_m: int) -> str:
    """CTEs ending in ``d (label, start, "end", drift)``."""
    vals = ", ".join(f"({a}, {b})" for a, b in steps)
    return with_(VEC_PAIRS, f"""
dranked AS (
  SELECT label, rank, diff FROM (
    SELECT *, row_number() OVER (PARTITION BY label ORDER BY {order_key(seed)}, claim_id, set_pos) AS rank FROM fpairs)
  WHERE rank <= {max_m}
),
dx AS (SELECT label, rank, unnest(diff) AS x, generate_subscripts(diff, 1) AS pos FROM dranked),
drun AS (
  SELECT label, rank, pos,
         avg(x) OVER (PARTITION BY label, pos ORDER BY rank ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS c
  FROM dx
),
dsizes AS (SELECT label, max(rank) AS size FROM dranked GROUP BY label),
dsteps AS (SELECT * FROM (VALUES {vals}) s(start, "end")),
dg AS (
  SELECT z.label, s.start, s."end", least(s.start, z.size) AS ra, least(s."end", z.size) AS rb
  FROM dsizes z CROSS JOIN dsteps s
),
d AS (
  SELECT g.label, g.start, g."end", sqrt(sum((b.c - a.c) * (b.c - a.c))) AS drift
  FROM dg g JOIN drun a ON a.label = g.label AND a.rank = g.ra
  JOIN drun b ON b.label = g.label AND b.rank = g.rb AND b.pos = a.pos
  GROUP BY g.label, g.start, g."end"
)""")


def run_log_sql() -> str:
    """CTEs: ``recs`` (the run records) and ``loglines`` (model, line_no,
    line) of the rendered log files."""
    means = ", ".join(f"sum(n_chars % {q}) / (count(*) * {q}) AS {n}" for n, q in RG.RECORD_METRICS.items())
    return f"""WITH recs AS (
  SELECT source AS model, (doc_id // 20 % 3 + 123)::INTEGER AS seed, (doc_id // 60 % 4 * 2 + 2)::INTEGER AS m,
         (doc_id // 240 % 5 + 1)::INTEGER AS run, {means}
  FROM documents GROUP BY ALL
),
numbered AS (SELECT *, row_number() OVER (PARTITION BY model ORDER BY seed, m, run) - 1 AS i FROM recs),
loglines AS (
  SELECT DISTINCT model, 0 AS line_no, 'fever_fever' AS line FROM recs
  UNION ALL SELECT model, 1 + i * 4, concat_ws(' ', m::VARCHAR, model, seed::VARCHAR) FROM numbered
  UNION ALL SELECT model, 2 + i * 4, '{RG.NOISE_LINE}' FROM numbered
  UNION ALL SELECT model, 3 + i * 4, 'Accuracy: ' || printf('%.4f', accuracy) FROM numbered
  UNION ALL SELECT model, 4 + i * 4, 'F1-macro: ' || printf('%.4f', f1) FROM numbered
)
"""


EIGHT = ["accuracy", "f1", "f1_s", "f1_n", "f1_c", "accuracy", "f1", "f1_s"]


def layout_sql(name: str) -> str:
    layout = runlogs.LAYOUTS[name]
    source = {"s": "f1_s", "n": "f1_n", "c": "f1_c", "not": "f1_n"}
    source |= {n: c for (n, _), c in zip(runlogs.LAYOUTS["before_after"].fields[3:], EIGHT)}
    return run_log_sql() + "SELECT " + ", ".join(
        (f'round({source.get(n, n)}, 4) AS "{n}"' if t == "double" else f'{n}') for n, t in layout.fields if n) + " FROM recs"


def before_after_sql() -> str:
    """Before: prototypes of the difference vectors.  After: of the three values that the cell's ridge map gives."""
    parts = [fitted_ctes(RG.SMALL_SEEDS, RG.SMALL_SHOTS, "ridge"), """
zprotos AS MATERIALIZED (
  SELECT seed, m, list(struct_pack(label := label, centroid := c) ORDER BY label) AS ps FROM (
    SELECT seed, m, label, [avg(z[1]), avg(z[2]), avg(z[3])] AS c FROM fz WHERE rank <= m GROUP BY seed, m, label)
  GROUP BY seed, m
),
zscored AS MATERIALIZED (
  SELECT f.seed, f.m, f.rank, f.label AS truth, """ + argmax_label("f.z", "k.ps") + """ AS pred
  FROM fz f JOIN zprotos k ON k.seed = f.seed AND k.m = f.m
)"""]
    for split, own in (("fit", "rank <= m"), ("dev", "rank > m")):
        parts.append(sweep_sql(RG.SMALL_SEEDS, RG.SMALL_SHOTS, split=split, p=f"b{split}_", head=False))
        parts.append(f"""
a{split}_cscored AS (SELECT seed, m, truth, pred FROM zscored WHERE {own}),""" + metrics_ctes(f"a{split}_"))
    return with_recursive(VEC_PAIRS.replace("fpairs AS (", "fpairs AS MATERIALIZED ("), *parts) + """
, rec AS (
  SELECT bf.seed, bf.m,
         bf.accuracy AS before_acc_train, bf.f1_macro AS before_f1_train,
         bd.accuracy AS before_acc_dev, bd.f1_macro AS before_f1_dev,
         af.accuracy AS after_acc_train, af.f1_macro AS after_f1_train,
         ad.accuracy AS after_acc_dev, ad.f1_macro AS after_f1_dev
  FROM bfit_csummary bf JOIN bdev_csummary bd USING (seed, m)
  JOIN afit_csummary af USING (seed, m) JOIN adev_csummary ad USING (seed, m)
)
"""


def add_reporting(q: dict[str, str]) -> None:
    steps = list(zip(RG.DRIFT_SHOTS, RG.DRIFT_SHOTS[1:]))
    q["drift_consecutive"] = drift_sql(RG.SEED, steps, max(RG.DRIFT_SHOTS)) + f"""
SELECT {RG.SEED} AS seed, start::VARCHAR || '_' || "end"::VARCHAR AS step, start::INTEGER AS start, "end"::INTEGER AS "end",
       round(max(CASE WHEN label = 0 THEN drift END), 4) AS Support,
       round(max(CASE WHEN label = 1 THEN drift END), 4) AS Neutral,
       round(max(CASE WHEN label = 2 THEN drift END), 4) AS Contradict
FROM d GROUP BY start, "end"
"""
    three = ", ".join(f"round(max(CASE WHEN label = {i} THEN drift END), 3) AS {n}"
                      for i, n in enumerate(("Support", "Neutral", "Contradict")))
    # the sink formats values that were rounded to four decimals before
    q["read_drift"] = drift_sql(RG.SEED, steps, max(RG.DRIFT_SHOTS)) + f"""
SELECT start::VARCHAR || '_' || "end"::VARCHAR AS step, start::INTEGER AS start, "end"::INTEGER AS "end", {three}
FROM (SELECT label, start, "end", round(drift, 4) AS drift FROM d) GROUP BY start, "end"
"""
    base = RG.DRIFT_BASE_SHOTS
    bsteps = [(base[0], n) for n in base[1:]]
    q["drift_from_base"] = drift_sql(RG.SEED, bsteps, max(base)) + f"""
SELECT {RG.SEED} AS seed, ("end" - start)::INTEGER AS step,
       round(max(CASE WHEN label = 0 THEN drift / ("end" - start) END), 4) AS s,
       round(max(CASE WHEN label = 1 THEN drift / ("end" - start) END), 4) AS n,
       round(max(CASE WHEN label = 2 THEN drift / ("end" - start) END), 4) AS c
FROM d GROUP BY start, "end"
"""
    parts = [f"""SELECT '{metric}' AS metric, a.label, s.start::INTEGER AS start, s."end"::INTEGER AS "end", round({fn('a.v', 'b.v')}, 4) AS drift
FROM steps s JOIN vecs a ON a.rank = s.start JOIN vecs b ON b.rank = s."end" AND b.label = a.label"""
             for metric, fn in (("euclidean", ved), ("cosine", _cos), ("triangle", lambda a, b: f"({_triangle(a, b)} * {_sector(a, b)})"))]
    q["drift_metrics"] = drift_sql(RG.SEED, bsteps, max(base)) + f""",
steps AS (SELECT DISTINCT start, "end" FROM d),
vecs AS MATERIALIZED (SELECT label, rank, list(c ORDER BY pos) AS v FROM drun GROUP BY label, rank)
""" + " UNION ALL ".join(parts)
    q["after_marker"] = run_log_sql() + "SELECT model, (line_no - 1)::INTEGER AS line_no, line FROM loglines WHERE line_no > 0"
    q["drop_noise"] = run_log_sql() + f"""SELECT model, (row_number() OVER (PARTITION BY model ORDER BY line_no) - 1)::INTEGER AS line_no, line
        FROM loglines WHERE line <> '{RG.NOISE_LINE}'"""
    q["parse_runs"] = q["parse_runs_stride"] = layout_sql("prototype_plain")
    for name in runlogs.LAYOUTS:
        q[f"parse_{name}"] = layout_sql(name)
    rates = []
    for i, seed in enumerate((RG.SEED, RG.SEED + 1)):
        cols = ", ".join(f"round(round(max(CASE WHEN label = {j} THEN drift / (\"end\" - start) END), 4), 3) AS {c}" for j, c in enumerate("snc"))
        rates.append(f"SELECT * FROM ({drift_sql(seed, [(RG.DRIFT_BASE_SHOTS[0], n) for n in RG.DRIFT_BASE_SHOTS[1:]], max(RG.DRIFT_BASE_SHOTS))}"
                     f"SELECT (\"end\" - start)::INTEGER AS step, {cols} FROM d GROUP BY start, \"end\")")
    q["drift_rate_log"] = " UNION ALL ".join(rates)
    names = [n for n, _ in runlogs.LAYOUTS["before_after"].fields[3:]]
    sums = [f"round({f}({c}), 3) AS {k}_{n}" for k, f in (("mean", "avg"), ("std", "stddev_pop")) for n, c in zip(names, EIGHT)]
    q["summary_sink"] = run_log_sql() + f"SELECT model, m, {', '.join(sums)} FROM recs GROUP BY model, m"
    q["runs_mean_stdpop"] = run_log_sql() + """SELECT model, m,
        round(avg(accuracy), 4) AS mean_acc, round(avg(f1_s), 4) AS mean_s, round(avg(f1_n), 4) AS mean_n,
        round(avg(f1_c), 4) AS mean_c, round(stddev_pop(accuracy), 4) AS std_acc, round(stddev_pop(f1_s), 4) AS std_s,
        round(stddev_pop(f1_n), 4) AS std_n, round(stddev_pop(f1_c), 4) AS std_c
        FROM recs GROUP BY model, m"""
    q["runs_mean_stdsamp"] = run_log_sql() + """SELECT model, m,
        round(avg(accuracy), 4) AS accuracy_mean, round(avg(f1), 4) AS f1_mean,
        round(stddev_samp(accuracy), 4) AS accuracy_sd, round(stddev_samp(f1), 4) AS f1_sd
        FROM recs GROUP BY model, m"""
    q["trend_series"] = run_log_sql() + """SELECT model, m, round(avg(accuracy), 4) AS accuracy, round(avg(f1), 4) AS f1
        FROM recs GROUP BY model, m"""
    q["trend_point"] = run_log_sql() + """SELECT model, m, round(avg(accuracy), 4) AS accuracy, round(avg(f1), 4) AS f1
        FROM recs WHERE m = 4 GROUP BY model, m"""
    q["trend_model"] = run_log_sql() + f"""SELECT model, m, round(avg(accuracy), 4) AS accuracy, round(avg(f1), 4) AS f1
        FROM recs WHERE model = '{RG.TREND_MODEL}' GROUP BY model, m"""
    q["average_runs"] = run_log_sql() + """SELECT model, seed, m, round(avg(accuracy), 4) AS accuracy,
        round(avg(f1), 4) AS f1, count(*) AS n_runs FROM recs GROUP BY model, seed, m"""
    metrics = RG.BEFORE_AFTER_METRICS
    cols = ", ".join([f"round(avg({x}), 4) AS mean_{x}" for x in metrics]
                     + [f"round(stddev_pop({x}), 4) AS std_{x}" for x in metrics])
    q["before_after_summary"] = before_after_sql() + f"SELECT m, {cols} FROM rec GROUP BY m"


def oracle_sql() -> dict[str, str]:
    q = build()
    add_reporting(q)
    return q

"""The registered queries of this subpackage, and their DuckDB equivalents where SQL can express them whole."""

from __future__ import annotations

from .op1_additive import op1_additive
from .op2_licenses import op2_licenses
from .op3_packing import op3_packing
from .op4_pii import op4_pii
from .op5_crosspolytope import op5_crosspolytope
from .op6_secrets import op6_secrets
from .op7_language import op7_language
from .op8_bpe import op8_bpe
from .op9_quality import op9_quality
from .op10_simhash import op10_simhash

QUERIES = {f.__name__: f for f in (op1_additive, op2_licenses, op3_packing, op4_pii, op5_crosspolytope, op6_secrets, op7_language, op8_bpe, op9_quality, op10_simhash)}
#: All pairs of vectors, and what is reachable over the links. (Neither trained models, tokenizers nor XXH64 exist in SQL, and a search by codes may miss a
#: neighbour that SQL would find.)
ORACLES = {
    "op5_crosspolytope": """WITH RECURSIVE u AS (SELECT vec_id, list_transform(e, lambda x: x / sqrt(list_dot_product(e, e))) AS e FROM (SELECT vec_id, list_transform(embedding, lambda x: CASE WHEN isfinite(x) THEN x ELSE 0 END)::DOUBLE[] AS e, len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) AS bad FROM embeddings WHERE embedding IS NOT NULL)
  WHERE bad = 0 AND len(list_filter(e, lambda x: x <> 0)) > 0),
 links AS (SELECT a.vec_id AS a, b.vec_id AS b FROM u a JOIN u b ON a.vec_id <> b.vec_id AND len(a.e) = len(b.e) AND list_dot_product(a.e, b.e) >= 0.9),
 reach AS (SELECT vec_id AS a, vec_id AS b FROM embeddings UNION SELECT r.a, l.b FROM reach r JOIN links l ON l.a = r.b),
 least AS (SELECT a, min(b) AS component_id FROM reach GROUP BY a), degree AS (SELECT a, count(*) AS n FROM links GROUP BY a)
 SELECT v.vec_id, coalesce(n, 0) AS n_links, component_id, v.vec_id = component_id AS kept FROM embeddings v JOIN least ON least.a = v.vec_id LEFT JOIN degree ON degree.a = v.vec_id""",
}

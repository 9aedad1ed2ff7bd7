"""Evidence, scoring, persona migration and stylometry queries."""
from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import fixed, scores
from ..lineage import cut_lineage
from ..operators import cosine_join, evidence, metrics, nearest, rebrand, resolve, stylometry
from .inputs import ctes, derived, table
from .q_text import RATIO_SQL, type_case, values_sql
from .registry import query

# --- evidence ------------------------------------------------------------------
EVIDENCE_EXPR = f"""l_orderkey as pair_id, {type_case('l_partkey')} as evidence_type,
  case when l_linenumber = 5 then l_quantity when l_linenumber = 6 then 0.0 end as lr,
  substr('ABCDEFG', cast(l_suppkey % 7 + 1 as int), 1) as reliability, l_linenumber % 8 as credibility"""
TYPES_SQL = values_sql([(t, r, f, d) for t, (r, f, d) in fixed.EVIDENCE_TYPES.items()])
EV = f"""with ev as (select {EVIDENCE_EXPR.replace('0.0 end', '0.0 end::double')} from lineitem),
ty as (select * from {TYPES_SQL} t(k, ratio, family, description)),
re as (select * from {values_sql(list(fixed.RELIABILITY.items()))} t(g, rf)), cr as (select * from {values_sql(list(fixed.CREDIBILITY.items()))} t(c, cf)),
adj as (select pair_id, evidence_type, coalesce(lr, ratio, 1.0)::double as effective_lr, coalesce(family, 'handle') as family, coalesce(description, evidence_type) as description,
  case when coalesce(lr, ratio, 1.0) <= 0 then 0.0 else ln(coalesce(lr, ratio, 1.0)::double) * coalesce(rf, 0.5)::double * coalesce(cf, 0.5)::double end as llr
  from ev left join ty on k = evidence_type left join re on g = reliability left join cr on c = credibility),
raw as (select pair_id, family, 0.5 * sum(llr) + 0.5 * max(llr) as raw_llr, count(*) as items from adj group by 1, 2),
fam as (select *, case family when 'temporal' then least(raw_llr, 0.5) when 'handle' then least(raw_llr, 3.0) else raw_llr end as family_llr from raw)"""


def evidence_rows(spark, sf) -> DataFrame:
    return table(spark, sf, "lineitem").selectExpr(*_columns(EVIDENCE_EXPR))


def _columns(text: str) -> list[str]:
    """Split a select list at top-level commas."""
    out, depth, start = [], 0, 0
    for i, ch in enumerate(text):
        depth += (ch == "(") - (ch == ")")
        if ch == "," and depth == 0:
            out.append(text[start:i])
            start = i + 1
    return out + [text[start:]]


@query("ev_registry", f"""
with l as (select distinct {type_case('l_partkey')} as t from lineitem), ty as (select * from {TYPES_SQL} t(k, ratio, family, description))
select t as evidence_type, coalesce(ratio, 1.0)::double as default_lr, coalesce(family, 'handle') as family, coalesce(description, t) as description from l left join ty on k = t""")
def ev_registry(spark, sf):
    t = F.col("evidence_type")
    return evidence_rows(spark, sf).select("evidence_type").distinct().select(
        t, scores.default_ratio(t).alias("default_lr"), scores.family(t).alias("family"), scores.description(t).alias("description")
    )


@query("ev_adjust", EV + """
select evidence_type, family, count(*) as n, round(sum(llr), 4) as llr from adj group by 1, 2""")
def ev_adjust(spark, sf):
    return evidence.adjust(evidence_rows(spark, sf)).groupBy("evidence_type", "family").agg(
        F.count(F.lit(1)).alias("n"), F.round(F.sum("adjusted_llr"), 4).alias("llr")
    )


@query("agg_llr_family", EV + " select pair_id, family, round(family_llr, 6) as family_llr, items, family_llr < raw_llr as capped from fam")
def agg_llr_family(spark, sf):
    out = evidence.by_family(evidence.adjust(evidence_rows(spark, sf)), ["pair_id"])
    return out.select("pair_id", "family", F.round("family_llr", 6).alias("family_llr"), "items", "capped")


@query("agg_link_score", EV + """
, s as (select pair_id, sum(family_llr) as t, count(*) filter (family_llr < raw_llr) as warnings from fam group by 1),
p as (select *, 0.001::double * exp(t) / (1 + 0.001::double * exp(t)) as posterior, greatest(0.0, least(100.0, round(100.0::double * 0.001::double * exp(t) / (1 + 0.001::double * exp(t)), 1))) as score from s)
select pair_id, score, round(posterior, 6) as posterior, warnings,
  case when score >= 90 then 'VERY_HIGH' when score >= 75 then 'HIGH' when score >= 50 then 'MODERATE' when score >= 25 then 'LOW' else 'WEAK' end as band, 'pending' as analyst_status from p""")
def agg_link_score(spark, sf):
    out = evidence.score_links(evidence_rows(spark, sf), ["pair_id"])
    return out.select(
        "pair_id", "score", F.round("posterior", 6).alias("posterior"), F.size("warnings").cast("long").alias("warnings"), "band", "analyst_status"
    )


@query("agg_why", EV + """
select pair_id, array_to_string(list(description order by -round(llr, 9), description), '; ') as why from adj group by pair_id""")
def agg_why(spark, sf):
    adjusted = evidence.adjust(evidence_rows(spark, sf))
    return evidence.why(adjusted, ["pair_id"]).select("pair_id", F.array_join("why", "; ").alias("why"))


# --- persona migration -------------------------------------------------------------
AT = "2001-08-01 00:00:00"
P = ctes("personas")
CAND = P + f"""
, cand as (select o.actor_id as old_id, n.actor_id as new_id, o.last_seen as ol, n.first_seen as nf,
  cast(floor((epoch(timestamp '{AT}') - epoch(o.last_seen)) / 86400) as bigint) as dormancy_days, cast(floor((epoch(n.first_seen) - epoch(o.last_seen)) / 86400) as bigint) as gap_days
  from personas o join personas n on n.first_seen >= o.last_seen and n.first_seen <= o.last_seen + interval 45 days
  where o.last_seen < timestamp '{AT}' - interval 14 days and n.last_seen >= timestamp '{AT}' - interval 14 days
    and not floor((epoch(least(o.last_seen, n.last_seen)) - epoch(greatest(o.first_seen, n.first_seen))) / 86400) > 3)"""


def at():
    return F.lit(AT).cast("timestamp")


@query("jn_rebrand", CAND + " select old_id, new_id from cand")
def jn_rebrand(spark, sf):
    return rebrand.candidates(derived(spark, sf, "personas"), at()).select("old_id", "new_id")


@query("rb_candidates", CAND + " select old_id, new_id, dormancy_days, gap_days from cand")
def rb_candidates(spark, sf):
    return rebrand.candidates(derived(spark, sf, "personas"), at())


@query("rb_partner_counts", P + f"""
select o.actor_id as old_id, count(n.actor_id) as partners from personas o
left join (select * from personas where last_seen >= timestamp '{AT}' - interval 14 days) n on n.first_seen >= o.last_seen and n.first_seen <= o.last_seen + interval 45 days
where o.last_seen < timestamp '{AT}' - interval 14 days group by 1""")
def rb_partner_counts(spark, sf):
    """How many candidates each dormant persona has, without listing them."""
    return rebrand.partner_counts(derived(spark, sf, "personas"), at())


LINKED = """
, pi as (select actor_id, unnest(list_concat(list_concat(list_transform(pgp_fingerprints, lambda x: 'p' || x), list_transform(contact_ids, lambda x: 'c' || x)), list_transform(wallet_addresses, lambda x: 'w' || x))) as k from personas),
linked as (select distinct c.* from cand c join pi a on a.actor_id = c.old_id join pi b on b.actor_id = c.new_id and a.k = b.k)"""


@query("rb_linked", CAND + LINKED + " select old_id, new_id, dormancy_days, gap_days from linked")
def rb_linked(spark, sf):
    """Candidates that share a key, contact or wallet."""
    return rebrand.linked_candidates(derived(spark, sf, "personas"), at())


SHARING = """
, pi as (select distinct actor_id, unnest(list_concat(list_concat(list_transform(pgp_fingerprints, lambda x: 'p' || x), list_transform(contact_ids, lambda x: 'c' || x)), list_transform(wallet_addresses, lambda x: 'w' || x))) as k from personas),
sharing as (select a.actor_id as a, b.actor_id as b, count(*) filter (k[1] = 'p') as pgp, count(*) filter (k[1] = 'c') as contacts, count(*) filter (k[1] = 'w') as wallets
  from pi a join pi b using (k) where a.actor_id < b.actor_id group by 1, 2)"""


@query("rb_coactive", P + SHARING + """
select a, b, floor((epoch(least(x.last_seen, y.last_seen)) - epoch(greatest(x.first_seen, y.first_seen))) / 86400) > 3 as co_active
from sharing join personas x on x.actor_id = a join personas y on y.actor_id = b""")
def rb_coactive(spark, sf):
    """All pairs of personas that share an identifier: were they active together?"""
    pairs = resolve.sharing_pairs(derived(spark, sf, "personas"), keep=["first_seen", "last_seen"])
    seen = [F.col(c) for c in ("a_first_seen", "a_last_seen", "b_first_seen", "b_last_seen")]
    return pairs.select("a", "b", rebrand.co_active(*seen).alias("co_active"))


@query("set_shared", P + SHARING + " select * from sharing")
def set_shared(spark, sf):
    """How many identifiers of each kind two personas share, for all pairs that share any."""
    return resolve.sharing_pairs(derived(spark, sf, "personas"))


EVIDENCE = CAND.replace("with ", "with recursive ", 1) + LINKED + """
, pr as (select l.*, o.pgp_fingerprints as op, n.pgp_fingerprints as np, o.contact_ids as oc, n.contact_ids as nc, o.wallet_addresses as ow, n.wallet_addresses as nw,
  list_dot_product(o.style_vector, n.style_vector) / (sqrt(list_dot_product(o.style_vector, o.style_vector)) * sqrt(list_dot_product(n.style_vector, n.style_vector))) as sim
  from linked l join personas o on o.actor_id = l.old_id join personas n on n.actor_id = l.new_id),
hq as (select old_id, new_id, h1, unnest(h2) as h2 from (select l.old_id, l.new_id, unnest(o.handles) as h1, n.handles as h2 from linked l join personas o on o.actor_id = l.old_id join personas n on n.actor_id = l.new_id) t),
hp as (select distinct lower(h1) || ' ~ ' || lower(h2) as id, lower(h1) as x, lower(h2) as y from hq), """ + RATIO_SQL + """,
evid as (select old_id, new_id, 'pgp_fingerprint' as evidence_type, cast(null as double) as lr, 'A' as reliability, 1 as credibility, v as detail from (select *, unnest(list_intersect(op, np)) as v from pr) t
 union all select old_id, new_id, 'contact_id', null, 'B', 2, v from (select *, unnest(list_intersect(oc, nc)) as v from pr) t
 union all select old_id, new_id, 'wallet_cluster', null, 'B', 2, array_to_string(list_sort(list_intersect(ow, nw)), ',') from pr where len(list_intersect(ow, nw)) > 0
 union all select old_id, new_id, 'stylometry', 2 + sim * 20, 'C', 3, null from pr where sim > 0.6
 union all select old_id, new_id, 'temporal_overlap', greatest(1.5, 5 - gap_days * 0.1), 'B', 3, cast(gap_days as varchar) from pr where gap_days <= 45
 union all select old_id, new_id, 'handle_exact', null, 'C', 3, h1 || ' ~ ' || h2 from hq where lower(h1) = lower(h2)
 union all select old_id, new_id, 'handle_similar', 5 * ratio, 'C', 3, h1 || ' ~ ' || h2 from hq join ha on ha.id = lower(h1) || ' ~ ' || lower(h2) where lower(h1) <> lower(h2) and ratio >= 0.7)"""


def _linked_evidence(spark, sf) -> DataFrame:
    return _evidence_of(cut_lineage(derived(spark, sf, "personas"), "personas"))


def _evidence_of(p: DataFrame) -> DataFrame:
    return rebrand.pair_evidence(rebrand.linked_candidates(p, at()), p)


def _scores(p: DataFrame) -> DataFrame:
    return evidence.score_links(_evidence_of(p), rebrand.PAIR).select("old_id", "new_id", "score")


@query("ev_pairwise", EVIDENCE + " select old_id, new_id, evidence_type, round(lr, 6) as lr, reliability, credibility, case when evidence_type <> 'stylometry' then detail end as detail from evid")
def ev_pairwise(spark, sf):
    """All evidence of all linked candidates."""
    return _linked_evidence(spark, sf).select(
        "old_id", "new_id", "evidence_type", F.round("lr", 6).alias("lr"), "reliability", "credibility",
        F.when(F.col("evidence_type") != "stylometry", F.col("detail")).alias("detail"),
    )


@query("ev_handles", EVIDENCE + " select old_id, new_id, evidence_type, round(lr, 6) as lr, detail from evid where starts_with(evidence_type, 'handle_')")
def ev_handles(spark, sf):
    """Handle evidence of linked candidates."""
    out = _linked_evidence(spark, sf).filter(F.col("evidence_type").startswith("handle_"))
    return out.select("old_id", "new_id", "evidence_type", F.round("lr", 6).alias("lr"), "detail")


SCORES = EVIDENCE + f"""
, ty as (select * from {TYPES_SQL} t(k, ratio, family, description)), re as (select * from {values_sql(list(fixed.RELIABILITY.items()))} t(g, rf)),
cr as (select * from {values_sql(list(fixed.CREDIBILITY.items()))} t(c, cf)),
adj as (select old_id, new_id, evidence_type, family, description, coalesce(lr, ratio)::double as lr, reliability, credibility, ln(coalesce(lr, ratio)::double) * rf::double * cf::double as llr
  from evid join ty on k = evidence_type join re on g = reliability join cr on c = credibility),
fam as (select old_id, new_id, least(0.5 * sum(llr) + 0.5 * max(llr), case family when 'temporal' then 0.5 when 'handle' then 3.0 else 1e9 end) as f from adj group by old_id, new_id, family),
s as (select old_id, new_id, sum(f) as t from fam group by 1, 2),
sc as (select old_id, new_id, round(100.0::double * 0.001::double * exp(t) / (1 + 0.001::double * exp(t)), 1) as score from s)"""


@query("rb_alerts", SCORES + """
, w as (select old_id, new_id, array_to_string(list(description order by -round(llr, 9), description), '; ') as why,
  array_to_string(list(evidence_type || ':' || cast(round(lr * 1000) as bigint) || ':' || reliability || ':' || credibility order by evidence_type, lr, reliability, credibility), ';') as evidence_summary
  from adj group by old_id, new_id)
select 'persona_migration' as alert_type, sc.old_id, sc.new_id, o.handle as old_handle, n.handle as new_handle, score,
  case when score >= 90 then 'VERY_HIGH' when score >= 75 then 'HIGH' else 'MODERATE' end as band, 'pending' as analyst_status, why, evidence_summary
from sc join w on w.old_id = sc.old_id and w.new_id = sc.new_id join personas o on o.actor_id = sc.old_id join personas n on n.actor_id = sc.new_id where score >= 75""")
def rb_alerts(spark, sf):
    """Migration alerts with their reasons and evidence (type, a thousand times the ratio, grades)."""
    out = rebrand.detect(derived(spark, sf, "personas"), at())
    item = lambda e: F.concat_ws(":", e["type"], F.round(e["lr"] * 1000).cast("long").cast("string"), e["reliability"], e["credibility"].cast("string"))
    return out.select(
        "alert_type", "old_id", "new_id", "old_handle", "new_handle", "score", "band", "analyst_status",
        F.array_join("why", "; ").alias("why"), F.array_join(F.transform("evidence_summary", item), ";").alias("evidence_summary"),
    )


@query("rb_scores", SCORES + " select old_id, new_id, score from sc")
def rb_scores(spark, sf):
    """Scores of linked candidates from all evidence."""
    return _scores(cut_lineage(derived(spark, sf, "personas"), "personas"))


TRUTH = """
, truth as (select old_id, new_id, case when split_part(old_id, '-', 1) = split_part(new_id, '-', 1) then case when gap_days < 20 then 'easy' else 'hard' end else 'decoy' end as difficulty from cand)"""


@query("agg_eval_rebrand", SCORES + TRUTH + """
, c as (select difficulty, count(*) filter (difficulty <> 'decoy' and coalesce(score >= 50, false)) as tp, count(*) filter (difficulty = 'decoy' and coalesce(score >= 50, false)) as fp,
  count(*) filter (difficulty <> 'decoy' and not coalesce(score >= 50, false)) as fn, round(coalesce(avg(score), 0), 6) as avg_score from truth left join sc using (old_id, new_id) group by difficulty)
select *, case when tp + fp > 0 then round(tp / (tp + fp)::double, 6) else 0.0 end as "precision", case when tp + fn > 0 then round(tp / (tp + fn)::double, 6) else 0.0 end as recall from c""")
def agg_eval_rebrand(spark, sf):
    """The detector's scores against personas of one customer, over all candidates; pairs that share nothing have none.

    Pairs of one customer meet by customer and decoys with a score by identifier. A decoy without a score adds nothing to
    any figure, so it matters only whether there is one: the window holds more pairs than those listed.
    """
    p = cut_lineage(derived(spark, sf, "personas"), "personas")
    who = lambda c: F.get(F.split(c, "-"), F.lit(0)).cast("long")
    scored = cut_lineage(_scores(p), "scores")
    same = cut_lineage(rebrand.grouped_candidates(p, at(), who("actor_id")).select(
        *rebrand.PAIR, F.when(F.col("gap_days") < 20, "easy").otherwise("hard").alias("difficulty")
    ), "same-customer")
    decoys = scored.filter(who("old_id") != who("new_id")).select(*rebrand.PAIR, F.lit("decoy").alias("difficulty"))
    listed = same.unionByName(decoys)
    in_window = rebrand.partner_counts(p, at()).agg(F.coalesce(F.sum("partners"), F.lit(0)).alias("n"))
    rest = in_window.join(listed.agg(F.count(F.lit(1)).alias("known"))).filter("n > known")
    none = F.lit(None).cast("string")
    truth = listed.unionByName(rest.select(none.alias("old_id"), none.alias("new_id"), F.lit("decoy").alias("difficulty")))
    out = metrics.evaluate_pairs(truth, scored)
    return out.select("difficulty", "tp", "fp", "fn", *[F.round(c, 6).alias(c) for c in ("avg_score", "precision", "recall")])


# --- stylometry ----------------------------------------------------------------------
STOP = fixed.FUNCTION_WORDS
STOP_SQL = "(" + ", ".join(f"'{w}'" for w in STOP) + ")"
CHAR_TERMS = r"""
with w as (select doc_id, ' ' || x || ' ' as w, count(*) as c from (select doc_id, unnest(list_filter(regexp_split_to_array(lower(text), '[\s\pZ]+'), lambda y: y <> '')) as x from documents) t group by 1, 2),
n as (select doc_id, c, w, k from w, (values (3), (4), (5)) v(k) where length(w) >= k),
g as (select doc_id, c, substr(w, i, k) as term from (select doc_id, c, w, k, unnest(range(1, length(w) - k + 2)) as i from n) u),
tf as (select doc_id, term, sum(c) as tf from g group by 1, 2)"""
WORD_TERMS = rf"""
with t as (select doc_id, list_filter(regexp_extract_all(lower(text), '[\pL\pN_]{{2,}}'), lambda y: y not in {STOP_SQL}) as t from documents),
g as (select doc_id, unnest(list_concat(t, list_transform(range(1, len(t)), lambda i: t[i] || ' ' || t[i + 1]))) as term from t),
tf as (select doc_id, term, count(*) as tf from g group by 1, 2)"""
VOCAB = """
, vocab as (select term, cast(sum(tf) as bigint) as cf, count(*) as df, ln((1 + (select count(*) from documents))::double / (1 + count(*))) + 1 as idf from tf group by term order by cf desc, term limit 5000)"""
#: Texts whose cosine is at least this are reported as similar.
ALIKE = 0.6
SIM = VOCAB + f"""
, wt as (select doc_id, term, tf * idf as w from tf join vocab using (term)),
vec as (select doc_id, term, w / sqrt(sum(w * w) over (partition by doc_id)) as weight from wt),
rep as (select min(doc_id) as doc_id, count(*) as copies from documents group by text),
rv as (select doc_id, term, weight from vec join rep using (doc_id)),
dots as (select x.doc_id as a, y.doc_id as b, sum(x.weight * y.weight) as s from rv x join rv y on y.term = x.term and x.doc_id < y.doc_id group by 1, 2)
select a, b, round(s, 6) as similarity, p.copies as a_copies, q.copies as b_copies
from dots join rep p on p.doc_id = a join rep q on q.doc_id = b where s >= {ALIKE}"""
NEIGHBOURS = 5


def _docs(spark, sf) -> DataFrame:
    return table(spark, sf, "documents").select("doc_id", "text")


def _representatives(spark, sf) -> DataFrame:
    """(doc_id, copies): of equal texts the smallest id."""
    docs = table(spark, sf, "documents")
    texts = docs.groupBy(F.sha2("text", 256).alias("t")).agg(F.min("doc_id").alias("doc_id"), F.count(F.lit(1)).alias("copies"))
    return texts.select("doc_id", "copies")


def _alike(spark, sf, vectors: DataFrame) -> DataFrame:
    """All pairs of different texts of at least ``ALIKE``, with how many documents have each text."""
    reps = _representatives(spark, sf)
    kept = vectors.join(reps, "doc_id", "left_semi").select(F.col("doc_id").alias("id"), F.col("tid").alias("term"), "weight")
    out = cosine_join.similar_pairs(kept, ALIKE, marks=reps.select(F.col("doc_id").alias("id"), F.col("copies").alias("mark")))
    return out.select("a", "b", F.round("similarity", 6).alias("similarity"), F.col("a_mark").alias("a_copies"), F.col("b_mark").alias("b_copies"))


def _tfidf(spark, sf, terms: DataFrame) -> DataFrame:
    stored = cut_lineage(terms, "terms")
    n = table(spark, sf, "documents").count()
    return stylometry.tfidf(stored, cut_lineage(stylometry.numbered(stylometry.fit_vocabulary(stored, n)), "vocabulary"))


@query("agg_tfidf_fit", WORD_TERMS + VOCAB + " select term, cf, df, round(idf, 6) as idf from vocab")
def agg_tfidf_fit(spark, sf):
    n = table(spark, sf, "documents").count()
    out = stylometry.fit_vocabulary(stylometry.word_terms(_docs(spark, sf), STOP), n)
    return out.select("term", "cf", "df", F.round("idf", 6).alias("idf"))


@query("sty_char", CHAR_TERMS + SIM)
def sty_char(spark, sf):
    n = table(spark, sf, "documents").count()
    terms, vocabulary = stylometry.char_model(_docs(spark, sf), n)
    return _alike(spark, sf, stylometry.tfidf(terms, vocabulary))


@query("sty_word", WORD_TERMS + SIM)
def sty_word(spark, sf):
    return _alike(spark, sf, _tfidf(spark, sf, stylometry.word_terms(_docs(spark, sf), STOP)))


def _features(spark, sf) -> DataFrame:
    return cut_lineage(stylometry.feature_rows(_docs(spark, sf)), "features")


def feature_sql() -> str:
    """All features of a text as a list, in the order of the word list, punctuation and shapes."""
    quote = lambda c: "'" + c.replace("'", "''") + "'"
    words = ", ".join(f"len(list_filter(lw, lambda x: x = '{w}'))::double / greatest(len(w), 1)" for w in fixed.FUNCTION_WORDS)
    marks = ", ".join(f"(length(text) - length(replace(text, {quote(c)}, '')))::double / greatest(length(text), 1)" for c in fixed.PUNCTUATION + "!?")
    return rf"""
with t as (select doc_id, text, list_filter(regexp_split_to_array(text, '[\s\pZ]+'), lambda w: w <> '') as w from documents),
u as (select *, list_transform(w, lambda x: lower(x)) as lw, list_transform(w, lambda x: length(x)::double) as wl,
  list_filter(list_transform(regexp_split_to_array(text, '[.!?]+'), lambda s: len(list_filter(regexp_split_to_array(s, '[\s\pZ]+'), lambda w: w <> ''))::double), lambda n: n > 0) as sl from t),
f as (select doc_id, [{words}, {marks}, ((length(text) - length(replace(text, '...', ''))) // 3)::double / greatest(length(text), 1),
  coalesce(list_avg(wl), 0), coalesce(list_stddev_pop(wl), 0), coalesce(list_avg(sl), 0), coalesce(list_stddev_pop(sl), 0), len(list_distinct(lw))::double / greatest(len(w), 1),
  length(regexp_replace(text, '[^\p{{Lu}}]', '', 'g'))::double / greatest(length(text), 1), length(regexp_replace(text, '[^\p{{Nd}}]', '', 'g'))::double / greatest(length(text), 1)] as v from u),
x as (select doc_id, unnest(range(0, len(v))) as slot, unnest(v) as x from f),
sc as (select slot, avg(x) as mean, case when stddev_pop(x) = 0 then 1.0 else stddev_pop(x) end as scale from x group by slot)"""


@query("agg_scaler", feature_sql() + " select cast(slot as int) as slot, round(mean, 6) as mean, round(scale, 6) as scale from sc")
def agg_scaler(spark, sf):
    out = stylometry.fit_scaler(_features(spark, sf))
    return out.select("slot", F.round("mean", 6).alias("mean"), F.round("scale", 6).alias("scale"))


def neighbours_sql(vectors: str, clip: bool = False) -> str:
    """The nearest of every row of ``given`` (id, v; made by ``vectors``) by cosine over all pairs."""
    value = "greatest(0.0, s)" if clip else "s"
    return f"""{vectors},
n as (select id, v, sqrt(list_dot_product(v, v)) as len from given), w as (select id, list_transform(v, lambda x: x / len) as v from n where len > 0),
p as (select a.id, b.id as neighbour, round(list_dot_product(a.v, b.v), 9) as s from w a join w b on a.id <> b.id),
r as (select *, row_number() over (partition by id order by s desc, neighbour) as rank from p)
select id, cast(rank as integer) as rank, neighbour, round({value}, 6) as similarity from r where rank <= {NEIGHBOURS}"""


@query("sty_func", neighbours_sql(feature_sql() + """
, given as (select doc_id as id, list((x - mean) / scale order by slot) as v from x join sc using (slot) group by doc_id)""", clip=True))
def sty_func(spark, sf):
    rows = _features(spark, sf)
    z = stylometry.standardise(rows, stylometry.fit_scaler(rows))
    out = nearest.nearest(z.select(F.col("doc_id").alias("id"), F.col("features").alias("v")), NEIGHBOURS)
    return out.withColumn("similarity", F.round(F.greatest("similarity", F.lit(0.0)), 6))


@query("sty_embed", neighbours_sql("with given as (select vec_id as id, list_transform(embedding, lambda x: x::double) as v from embeddings)"))
def sty_embed(spark, sf):
    e = table(spark, sf, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").cast("array<double>").alias("v"))
    return nearest.nearest(e, NEIGHBOURS).withColumn("similarity", F.round("similarity", 6))

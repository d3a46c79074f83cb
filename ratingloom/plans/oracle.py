"""The registered queries as SQL over the same tables, for DuckDB.

Each entry is a chain of common table expressions; the building blocks below
are joined by :func:`_sql`. Settings repeat those of
:mod:`ratingloom.plans.queries`.
"""

from __future__ import annotations

from ratingloom.params import EvalParams, NeighbourParams, PopularityParams
from ratingloom.plans.queries import (
    DEFAULT_NUM,
    FOLD_TOPS,
    FOLDS,
    MIXED_NUMS,
    NEIGHBOURS,
    NUM,
    ORDER_NUM,
    ORDER_POPULAR,
    POPULAR,
    SWEEP_ITEMS,
    SWEEP_NEIGHBOURS,
)

_T, _N = NEIGHBOURS.min_common, NEIGHBOURS.top_n
_K = FOLDS.k_fold

EV = """ev AS (
  SELECT user_id AS "user", CAST(json_extract_string(props, '$.k') AS BIGINT) AS item,
         value AS rating, ts, event_id
  FROM events WHERE event_type = 'purchase')"""

ORDER_EV = """ev AS (
  SELECT o_custkey AS "user", l_suppkey AS item, l_quantity AS rating, o_orderdate AS ts,
         l_orderkey * 8 + l_linenumber AS event_id
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey)"""

LATEST = """r AS (
  SELECT "user", item, rating, ts, event_id FROM (
    SELECT *, row_number() OVER (PARTITION BY "user", item ORDER BY ts DESC, event_id DESC, rating DESC) AS newest
    FROM ev) WHERE newest = 1)"""

#: Every event counts, as in the compatible mode.
ALL_EVENTS = "r AS (SELECT * FROM ev)"

MEANS = """means AS (
  SELECT "user", count(*) AS n_ratings, round(avg(rating), 9) AS mean_rating FROM r GROUP BY "user")"""

LABELED = """labeled AS (
  SELECT r."user", r.item, r.rating, CASE WHEN r.rating > m.mean_rating THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS label
  FROM r JOIN means m ON m."user" = r."user")"""


def _likes(top_n: int) -> str:
    return f"""likes AS (
  SELECT "user", item, rating, rank FROM (
    SELECT r."user", r.item, r.rating,
           CAST(row_number() OVER (PARTITION BY r."user" ORDER BY r.rating DESC, r.item) AS INTEGER) AS rank
    FROM r JOIN means m ON m."user" = r."user"
    WHERE m.n_ratings < {top_n} OR r.rating > m.mean_rating) WHERE rank <= {top_n})"""


LIKES = _likes(_N)


def _pairs(before: str, value: str, min_common: int = _T) -> str:
    return f"""pairs AS (
  SELECT a."user" AS user_a, b."user" AS user_b, count(*) AS n_common, {value} AS similarity
  FROM latest a JOIN latest b ON a.item = b.item AND {before}
  GROUP BY a."user", b."user" HAVING count(*) >= {min_common})"""


LATEST_COPY = LATEST.replace("r AS (", "latest AS (", 1)
# whole numbers, so that sums don't depend on their order; values have two decimals
_X, _Y = ("CAST(round({}.rating * 100) AS HUGEINT)".format(side) for side in "ab")


def _spread(x: str, y: str) -> str:
    return f"(count(*) * sum({x} * {y}) - sum({x}) * sum({y}))"


def _quotient(above: str, left: str, right: str) -> str:
    return f"CAST({above} AS DOUBLE) / sqrt(CAST({left} AS DOUBLE) * CAST({right} AS DOUBLE))"


VARIED = f"{_spread(_X, _X)} > 0 AND {_spread(_Y, _Y)} > 0"
PEARSON = f"CASE WHEN {VARIED} THEN {_quotient(_spread(_X, _Y), _spread(_X, _X), _spread(_Y, _Y))} END"
COSINE = _quotient(f"sum({_X} * {_Y})", f"sum({_X} * {_X})", f"sum({_Y} * {_Y})")
ROUNDED = "SELECT * REPLACE (round(similarity, 9) + 0.0 AS similarity) FROM "
BY_NUMBER = 'a."user" < b."user"'
BY_TEXT = 'CAST(a."user" AS VARCHAR) < CAST(b."user" AS VARCHAR)'

SIDES = """sides AS (
  SELECT user_a AS "user", user_b AS neighbour, similarity FROM pairs WHERE similarity > 0
  UNION ALL SELECT user_b, user_a, similarity FROM pairs WHERE similarity > 0)"""
SIDES_COMPAT = """sides AS (
  SELECT user_a AS "user", user_b AS neighbour, similarity FROM pairs WHERE similarity > 0)"""



def _nearest(top_n: int) -> str:
    return f"""nearest AS (
  SELECT "user", neighbour, similarity, rank FROM (
    SELECT *, CAST(row_number() OVER (PARTITION BY "user" ORDER BY similarity DESC, neighbour) AS INTEGER) AS rank
    FROM sides) WHERE rank <= {top_n})"""


NEAREST = _nearest(_N)

CANDIDATES = """cand AS (
  SELECT n."user", l.item, round(sum(l.rating * n.similarity), 9) AS score
  FROM nearest n JOIN likes l ON l."user" = n.neighbour
  WHERE NOT EXISTS (SELECT 1 FROM ev e WHERE e."user" = n."user" AND e.item = l.item)
  GROUP BY n."user", l.item)"""

BAYES = """sums AS (
  SELECT label, count(*) AS n_rows, CAST(sum("user") AS BIGINT) AS sum_user, CAST(sum(item) AS BIGINT) AS sum_item
  FROM labeled GROUP BY label),
bayes AS (
  SELECT label, n_rows, sum_user, sum_item,
         ln(n_rows + 1) - ln((SELECT sum(n_rows) FROM sums) + 2) AS pi,
         ln(sum_user + 1) - ln(sum_user + sum_item + 2) AS theta_user,
         ln(sum_item + 1) - ln(sum_user + sum_item + 2) AS theta_item
  FROM sums)"""

LIKED = """c0 AS (SELECT * FROM bayes WHERE label = 0),
c1 AS (SELECT * FROM bayes WHERE label = 1),
judged AS (
  SELECT x.*, CASE WHEN c1.pi + x."user" * c1.theta_user + x.item * c1.theta_item
                      > c0.pi + x."user" * c0.theta_user + x.item * c0.theta_item
              THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS prediction
  FROM {source} x, c0, c1)"""

def _asked(num: int) -> str:
    return f'asked AS (SELECT DISTINCT user_id AS "user", {num} AS num FROM events)'


def _bayes_list(num: int) -> str:
    return f"""best AS (
  SELECT "user", item, score, rank FROM (
    SELECT "user", item, score,
           CAST(row_number() OVER (PARTITION BY "user" ORDER BY score DESC, item) AS INTEGER) AS rank
    FROM judged WHERE prediction = 1 AND "user" IN (SELECT "user" FROM asked)) WHERE rank <= {num}),
nb AS (
  SELECT "user", item, round(score / sum(score) OVER (PARTITION BY "user") * 2.0, 9) AS score, rank FROM best)"""


ASKED = _asked(NUM)
BAYES_LIST = _bayes_list(NUM)

#: Every candidate over the total of the accepted list.
BAYES_LIST_COMPAT = f"""best AS (
  SELECT "user", item, score, rank FROM (
    SELECT "user", item, score, row_number() OVER (PARTITION BY "user" ORDER BY score DESC, item) AS rank
    FROM judged WHERE prediction = 1) WHERE rank <= {NUM}),
totals AS (SELECT "user", sum(score) AS total FROM best GROUP BY "user"),
nb AS (
  SELECT c."user", c.item,
         CASE WHEN coalesce(t.total, 0) <> 0 THEN round(c.score / t.total * 2.0, 9)
              WHEN c.score = 0 THEN 'NaN'::DOUBLE WHEN c.score > 0 THEN 'Infinity'::DOUBLE
              ELSE '-Infinity'::DOUBLE END AS score
  FROM cand c LEFT JOIN totals t ON t."user" = c."user" WHERE c."user" IN (SELECT "user" FROM asked))"""


def _labelled(table: str, column: str) -> str:
    keep = f"CASE WHEN isfinite({column}) THEN {column} END AS {column}"
    kind = (
        f"CASE WHEN {column} IS NULL THEN 'null' WHEN isnan({column}) THEN 'nan' "
        f"WHEN isinf({column}) THEN 'infinite' ELSE 'finite' END AS {column}_kind"
    )
    return f"SELECT * REPLACE ({keep}), {kind} FROM {table}"


VIEWS = "views AS (SELECT item, count(*) AS views FROM ev GROUP BY item)"


def _prune(max_items: int, passes: int = 12) -> str:
    """Pruning passes, each a no-op once few enough items are left."""
    steps = ["p0 AS (SELECT * FROM views)"]
    for i in range(passes):
        steps.append(
            f"p{i + 1} AS (SELECT p.* FROM p{i} p, (SELECT count(*) AS n, avg(views) AS mean FROM p{i}) s "
            f"WHERE s.n <= {2 * max_items} OR p.views > s.mean)"
        )
    return ",\n".join(steps) + f",\npruned AS (SELECT * FROM p{passes})"


def _top(source: str, max_items: int) -> str:
    return f"""top AS (
  SELECT item, views, rank FROM (
    SELECT item, views, CAST(row_number() OVER (ORDER BY views DESC, item) AS INTEGER) AS rank FROM {source})
  WHERE rank <= {max_items})"""


POPULAR_LIST = """open AS (
  SELECT a."user", a.num, t.item, t.views,
         CAST(row_number() OVER (PARTITION BY a."user" ORDER BY t.rank) AS INTEGER) AS rank
  FROM asked a, top t
  WHERE NOT EXISTS (SELECT 1 FROM ev e WHERE e."user" = a."user" AND e.item = t.item)),
mv AS (
  SELECT "user", item, round(views / sum(views) OVER (PARTITION BY "user"), 9) AS score, rank
  FROM open WHERE rank <= num)"""

POPULAR_LIST_COMPAT = """mv AS (
  SELECT a."user", t.item,
         CAST(t.views // sum(t.views) OVER (PARTITION BY a."user") AS DOUBLE) AS score, t.rank
  FROM asked a, top t WHERE t.rank <= a.num)"""

def _blended(num: int) -> str:
    return f"""blended AS (
  SELECT "user", item, round(sum(score), 9) AS score FROM (
    SELECT "user", item, score FROM nb UNION ALL SELECT "user", item, score FROM mv)
  GROUP BY "user", item),
served AS (
  SELECT "user", item, score, rank FROM (
    SELECT *, CAST(row_number() OVER (PARTITION BY "user" ORDER BY score DESC, item) AS INTEGER) AS rank
    FROM blended) WHERE rank <= {num})"""


BLENDED = _blended(NUM)


def _hits(source: str, suffix: str) -> str:
    return f"""hits{suffix} AS (
  SELECT q.fold, q."user", q.n_actual, count(r.item) AS n_recommended, count(a.item) AS hits
  FROM fquery q LEFT JOIN {source} r ON r.fold = q.fold AND r."user" = q."user"
  LEFT JOIN actual a ON a.fold = r.fold AND a."user" = r."user" AND a.item = r.item
  GROUP BY q.fold, q."user", q.n_actual)"""


def _fold_hits(
    max_items: int, suffix: str = "", compat: bool = False, passes: int = 12, k: int = _K, num: int = NUM
) -> str:
    """Popularity trained without and judged on each fold; in ``compat`` pruned per fold, with seen items."""
    s = suffix
    prune, source, listed = "", f"fview{s}", "NOT EXISTS"
    if compat:
        steps = [f"fp0 AS (SELECT * FROM fview{s})"]
        for i in range(passes):
            steps.append(
                f"fp{i + 1} AS (SELECT p.* FROM fp{i} p JOIN (SELECT fold, count(*) AS n, avg(views) AS mean FROM fp{i} "
                f"GROUP BY fold) s USING (fold) WHERE s.n <= {2 * max_items} OR p.views > s.mean)"
            )
        prune, source, listed = ",\n".join(steps) + ",\n", f"fp{passes}", "true OR EXISTS"
    return f"""fview{s} AS (
  SELECT f.fold, e.item, count(*) AS views FROM ev e JOIN folds f ON e.event_id % {k} <> f.fold GROUP BY ALL),
{prune}ftop{s} AS (
  SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY fold ORDER BY views DESC, item) AS rank FROM {source})
  WHERE rank <= {max_items}),
frec{s} AS (
  SELECT * FROM (
    SELECT q.fold, q."user", t.item, t.views,
           row_number() OVER (PARTITION BY q.fold, q."user" ORDER BY t.rank) AS place
    FROM fquery q JOIN ftop{s} t ON t.fold = q.fold
    WHERE {listed} (SELECT 1 FROM ev e WHERE e."user" = q."user" AND e.item = t.item
                      AND e.event_id % {k} <> q.fold)) WHERE place <= {num}),
{_hits(f"frec{s}", s)}"""


def _fold_base(k: int) -> str:
    return f"""folds AS (SELECT CAST(range AS INTEGER) AS fold FROM range({k})),
actual AS (SELECT DISTINCT CAST(event_id % {k} AS INTEGER) AS fold, "user", item FROM ev),
fquery AS (SELECT fold, "user", count(*) AS n_actual FROM actual GROUP BY fold, "user")"""


FOLD_BASE = _fold_base(_K)


def _fold_pairs(k: int, min_common: int) -> str:
    """Every fold trained by itself: latest ratings, means and pairs of its training part."""
    return f"""ftrain AS (SELECT f.fold, e.* FROM ev e JOIN folds f ON e.event_id % {k} <> f.fold),
fr AS (
  SELECT fold, "user", item, rating FROM (
    SELECT *, row_number() OVER (PARTITION BY fold, "user", item ORDER BY ts DESC, event_id DESC, rating DESC) AS newest
    FROM ftrain) WHERE newest = 1),
fmeans AS (
  SELECT fold, "user", count(*) AS n_ratings, round(avg(rating), 9) AS mean_rating FROM fr GROUP BY fold, "user"),
fpairs AS (
  SELECT a.fold, a."user" AS user_a, b."user" AS user_b, count(*) AS n_common, {PEARSON} AS similarity
  FROM fr a JOIN fr b ON a.fold = b.fold AND a.item = b.item AND {BY_NUMBER}
  GROUP BY a.fold, a."user", b."user" HAVING count(*) >= {min_common}),
fsides AS (
  SELECT fold, user_a AS "user", user_b AS neighbour, n_common, similarity FROM fpairs WHERE similarity > 0
  UNION ALL SELECT fold, user_b, user_a, n_common, similarity FROM fpairs WHERE similarity > 0)"""


def _fold_nearest(min_common: int, top_n: int, suffix: str = "") -> str:
    return f"""fnearest{suffix} AS (
  SELECT fold, "user", neighbour, similarity, rank FROM (
    SELECT *, CAST(row_number() OVER (PARTITION BY fold, "user" ORDER BY similarity DESC, neighbour) AS INTEGER) AS rank
    FROM fsides WHERE n_common >= {min_common}) WHERE rank <= {top_n})"""


FOLD_BAYES = """fsums AS (
  SELECT fold, label, count(*) AS n_rows, CAST(sum("user") AS BIGINT) AS sum_user, CAST(sum(item) AS BIGINT) AS sum_item
  FROM (SELECT r.*, CASE WHEN r.rating > m.mean_rating THEN 1 ELSE 0 END AS label
        FROM fr r JOIN fmeans m ON m.fold = r.fold AND m."user" = r."user") GROUP BY fold, label),
fbayes AS (
  SELECT fold, label, ln(n_rows + 1) - ln(sum(n_rows) OVER (PARTITION BY fold) + 2) AS pi,
         ln(sum_user + 1) - ln(sum_user + sum_item + 2) AS theta_user,
         ln(sum_item + 1) - ln(sum_user + sum_item + 2) AS theta_item
  FROM fsums)"""


def _fold_bayes_lists(min_common: int, top_n: int, num: int, suffix: str = "") -> str:
    """Lists of the naive Bayes hybrid of every fold, from pairs of all folds."""
    s = suffix
    return f"""{_fold_nearest(min_common, top_n, s)},
flikes{s} AS (
  SELECT * FROM (
    SELECT r.*, row_number() OVER (PARTITION BY r.fold, r."user" ORDER BY r.rating DESC, r.item) AS place
    FROM fr r JOIN fmeans m ON m.fold = r.fold AND m."user" = r."user"
    WHERE m.n_ratings < {top_n} OR r.rating > m.mean_rating) WHERE place <= {top_n}),
fcand{s} AS (
  SELECT n.fold, n."user", l.item, round(sum(l.rating * n.similarity), 9) AS score
  FROM fnearest{s} n JOIN flikes{s} l ON l.fold = n.fold AND l."user" = n.neighbour
  WHERE NOT EXISTS (SELECT 1 FROM fr e WHERE e.fold = n.fold AND e."user" = n."user" AND e.item = l.item)
  GROUP BY n.fold, n."user", l.item),
fnb{s} AS (
  SELECT fold, "user", item, round(score / sum(score) OVER (PARTITION BY fold, "user") * 2.0, 9) AS score FROM (
    SELECT x.*, row_number() OVER (PARTITION BY x.fold, x."user" ORDER BY x.score DESC, x.item) AS place
    FROM fcand{s} x JOIN fbayes c1 ON c1.fold = x.fold AND c1.label = 1 JOIN fbayes c0 ON c0.fold = x.fold AND c0.label = 0
    JOIN fquery q ON q.fold = x.fold AND q."user" = x."user"
    WHERE c1.pi + x."user" * c1.theta_user + x.item * c1.theta_item
          > c0.pi + x."user" * c0.theta_user + x.item * c0.theta_item) WHERE place <= {num})"""


#: Of popularity (``frec``) and naive Bayes (``fnb``).
FOLD_BLEND = f"""fblend AS (
  SELECT fold, "user", item FROM (
    SELECT fold, "user", item, row_number() OVER (PARTITION BY fold, "user" ORDER BY round(sum(score), 9) DESC, item) AS place
    FROM (SELECT fold, "user", item, score FROM fnb
          UNION ALL SELECT fold, "user", item, round(views / sum(views) OVER (PARTITION BY fold, "user"), 9) FROM frec)
    GROUP BY fold, "user", item) WHERE place <= {NUM})"""

_PRECISION = "avg(CASE WHEN n_recommended > 0 THEN hits / n_recommended END)"
_RECALL = "avg(hits / n_actual)"


_FOLD_REPORT = f"""SELECT fold, count(*) AS n_queries, count(*) FILTER (n_recommended > 0) AS n_scored,
       round({_PRECISION}, 9) AS precision, round({_RECALL}, 9) AS recall FROM """


def _sweep(n_settings: int) -> str:
    """Report over ``hits_0``, ``hits_1``, ..."""
    rows = (
        f"SELECT {i} AS setting, count(*) AS n_queries, count(*) FILTER (n_recommended > 0) AS n_scored, "
        f"round({_PRECISION}, 9) AS precision, round({_RECALL}, 9) AS recall FROM hits_{i}"
        for i in range(n_settings)
    )
    return "sweep AS (" + "\nUNION ALL ".join(rows) + ")"


_SWEEP_REPORT = """SELECT *, row_number() OVER (ORDER BY precision DESC NULLS LAST, setting) = 1 AS is_best
FROM sweep"""


def _sql(*ctes: str, select: str) -> str:
    return "WITH " + ",\n".join(ctes) + "\n" + select


def _bayes_chain(min_common: int, top_n: int) -> tuple[str, ...]:
    pairs = _pairs(BY_NUMBER, PEARSON, min_common)
    return (EV, LATEST, LATEST_COPY, MEANS, LABELED, pairs, SIDES, _nearest(top_n), _likes(top_n), CANDIDATES)


_BAYES_CHAIN = _bayes_chain(_T, _N)
_COMPAT_CHAIN = (
    EV,
    ALL_EVENTS,
    LATEST_COPY,
    MEANS,
    LABELED,
    _pairs(BY_TEXT, PEARSON),
    SIDES_COMPAT,
    NEAREST,
    LIKES,
    CANDIDATES,
)
_JUDGED = (BAYES, LIKED.format(source="cand"), ASKED)


def _hybrid(
    num: int,
    columns: str = '"user", item, score, rank',
    chain: tuple[str, ...] = _BAYES_CHAIN,
    max_items: int = POPULAR.max_items,
) -> str:
    judged = (BAYES, LIKED.format(source="cand"), _asked(num))
    popular = (VIEWS, _top("views", max_items), POPULAR_LIST)
    return _sql(*chain, *judged, _bayes_list(num), *popular, _blended(num), select=f"SELECT {columns} FROM served")


_HYBRID = _hybrid(NUM)
_DEFAULT_CHAIN = _bayes_chain(NeighbourParams().min_common, NeighbourParams().top_n)

_STATS = """SELECT "user", count(*) AS n_ratings, round(avg(rating), 9) AS mean_rating,
       min(rating) AS min_rating, max(rating) AS max_rating FROM ev GROUP BY "user\""""

_SPLIT = """SELECT CAST(event_id % {k} AS INTEGER) AS fold,
       CAST((SELECT count(*) FROM ev) - count(*) AS BIGINT) AS n_train, count(*) AS n_test,
       count(DISTINCT "user") AS n_test_users
FROM ev GROUP BY event_id % {k}"""

_INDEX_FACTS = """SELECT '{side}' AS side, count(*) AS n, 0 AS min_idx, CAST(count(*) - 1 AS INTEGER) AS max_idx,
       count(*) AS n_idx, count(*) AS n_ids FROM (SELECT DISTINCT "{side}" FROM ev)"""

_BAYES_COLUMNS = """SELECT label, n_rows, sum_user, sum_item, round(pi, 9) AS pi,
       round(theta_user, 9) AS theta_user, round(theta_item, 9) AS theta_item FROM bayes"""

_CHI = """vals AS (
  SELECT 'user' AS feature, "user" AS value, label FROM labeled
  UNION ALL SELECT 'item', item, label FROM labeled),
cells AS (SELECT feature, value, count(*) AS n, sum(label) AS liked FROM vals GROUP BY feature, value),
rates AS (SELECT feature, sum(liked) / sum(n) AS rate, count(*) - 1 AS dof FROM cells GROUP BY feature),
chi AS (
  SELECT c.feature, r.dof,
         sum((c.liked - c.n * rate) ^ 2 / (c.n * rate)
             + (c.n - c.liked - c.n * (1 - rate)) ^ 2 / (c.n * (1 - rate))) AS statistic
  FROM cells c JOIN rates r ON r.feature = c.feature GROUP BY c.feature, r.dof)
"""

ORACLE: dict[str, str] = {
    "event_rating_scan": _sql(EV, select="SELECT * FROM ev"),
    "event_reject_report": """SELECT 'unexpected_event' AS reason, event_type AS event, count(*) AS n_rows,
       min(event_id) AS first_event_id, max(event_id) AS last_event_id
FROM events WHERE event_type <> 'purchase' GROUP BY event_type""",
    "dataset_summary": _sql(
        EV,
        select="""SELECT 'n_ratings' AS name, CAST(count(*) AS VARCHAR) AS value FROM ev
UNION ALL SELECT 'n_users', CAST(count(DISTINCT "user") AS VARCHAR) FROM ev
UNION ALL SELECT 'n_items', CAST(count(DISTINCT item) AS VARCHAR) FROM ev
UNION ALL SELECT 'sample', value FROM (
  SELECT printf('Rating(%d,%d,%.2f)', "user", item, rating) AS value FROM ev ORDER BY event_id LIMIT 2)""",
    ),
    "csv_rating_import": _sql(
        EV,
        select="""SELECT CAST("user" AS VARCHAR) AS "user", CAST(item AS VARCHAR) AS item, rating,
       CAST(floor(epoch(ts)) AS BIGINT) AS seconds FROM ev""",
    ),
    "csv_import_rejects": _sql(
        EV,
        select="""SELECT concat_ws(',', "user", item, CASE WHEN event_id % 7 = 0 THEN 'good' ELSE event_id::VARCHAR END,
                 CASE WHEN event_id % 11 = 0 THEN 'late' ELSE event_id::VARCHAR END) AS line,
       CASE WHEN event_id % 7 = 0 THEN 'rating' ELSE 'timestamp' END || ' is not a number' AS reason
FROM ev WHERE event_id % 7 = 0 OR event_id % 11 = 0""",
    ),
    "rating_dedup_latest": _sql(EV, LATEST, select="SELECT * FROM r"),
    "user_rating_stats": _sql(EV, select=_STATS),
    "user_history": _sql(
        EV,
        "pairs AS (SELECT DISTINCT \"user\", item FROM ev)",
        'sizes AS (SELECT "user", count(*) AS history_size FROM pairs GROUP BY "user")',
        select="""SELECT p."user",
       CAST(CAST('0x' || substr(md5(CAST(p.item AS VARCHAR)), 1, 8) AS BIGINT)
            % CAST(ceil(s.history_size / 10.0) AS BIGINT) AS INTEGER) AS part,
       s.history_size, string_agg(CAST(p.item AS VARCHAR), ',' ORDER BY p.item) AS items
FROM pairs p JOIN sizes s ON s."user" = p."user" GROUP BY 1, 2, 3""",
    ),
    "item_view_counts": _sql(EV, VIEWS, select="SELECT * FROM views"),
    "labeled_ratings": _sql(EV, LATEST, MEANS, LABELED, select="SELECT * FROM labeled"),
    "labeled_ratings_compat": _sql(EV, ALL_EVENTS, MEANS, LABELED, select="SELECT * FROM labeled"),
    "preference_coefficient": _sql(
        EV,
        LATEST,
        select="""SELECT "user", round(CASE WHEN min(rating) < max(rating)
       THEN (round(avg(rating), 9) - min(rating)) / (max(rating) - min(rating)) END, 9) AS preference
FROM r GROUP BY "user\"""",
    ),
    "mean_centered_ratings": _sql(
        EV,
        LATEST,
        MEANS,
        select="""SELECT r."user", r.item, r.rating, round(r.rating + (2.5 - m.mean_rating), 9) AS centered
FROM r JOIN means m ON m."user" = r."user\"""",
    ),
    "recent_items": _sql(
        EV,
        LATEST,
        select=f"""SELECT "user", item, rank FROM (
  SELECT *, CAST(row_number() OVER (PARTITION BY "user" ORDER BY ts DESC, event_id DESC) AS INTEGER) AS rank FROM r)
WHERE rank <= {NUM}""",
    ),
    "popularity_mean_prune": _sql(EV, VIEWS, _prune(POPULAR.max_items), select="SELECT * FROM pruned"),
    "most_viewed_topk": _sql(EV, VIEWS, _top("views", POPULAR.max_items), select="SELECT * FROM top"),
    "popular_unseen_per_user": _sql(
        EV, VIEWS, _top("views", POPULAR.max_items), ASKED, POPULAR_LIST, select="SELECT * FROM mv"
    ),
    "popular_per_user_compat": _sql(
        EV,
        VIEWS,
        _prune(POPULAR.max_items),
        _top("pruned", POPULAR.max_items),
        ASKED,
        POPULAR_LIST_COMPAT,
        select="SELECT * FROM mv",
    ),
    "order_user_stats": _sql(ORDER_EV, select=_STATS),
    "order_rating_latest": _sql(ORDER_EV, LATEST, select="SELECT * FROM r"),
    "order_most_viewed": _sql(ORDER_EV, VIEWS, _top("views", ORDER_POPULAR.max_items), select="SELECT * FROM top"),
    "order_popular_unseen": _sql(
        ORDER_EV,
        VIEWS,
        _top("views", ORDER_POPULAR.max_items),
        f'asked AS (SELECT c_custkey AS "user", {ORDER_NUM} AS num FROM customer)',
        POPULAR_LIST,
        select="SELECT * FROM mv",
    ),
    "pearson_pairs": _sql(EV, LATEST_COPY, _pairs(BY_NUMBER, PEARSON), select=ROUNDED + "pairs"),
    "cosine_pairs": _sql(EV, LATEST_COPY, _pairs(BY_NUMBER, COSINE), select=ROUNDED + "pairs"),
    "nearest_users": _sql(
        EV, LATEST_COPY, _pairs(BY_NUMBER, PEARSON), SIDES, NEAREST, select=ROUNDED + "nearest"
    ),
    "nearest_users_compat": _sql(
        EV, LATEST_COPY, _pairs(BY_TEXT, PEARSON), SIDES_COMPAT, NEAREST, select=ROUNDED + "nearest"
    ),
    "nearest_users_all_events": _sql(
        EV.replace("WHERE event_type = 'purchase'", ""),
        LATEST_COPY,
        _pairs(BY_NUMBER, PEARSON, NeighbourParams().min_common),
        SIDES,
        _nearest(NeighbourParams().top_n),
        select=ROUNDED + "nearest",
    ),
    "user_likes": _sql(EV, LATEST, MEANS, LIKES, select="SELECT * FROM likes"),
    "user_likes_compat": _sql(EV, ALL_EVENTS, MEANS, LIKES, select='SELECT "user", item, rating FROM likes'),
    "cf_candidates": _sql(*_BAYES_CHAIN, select="SELECT * FROM cand"),
    "cf_candidates_compat": _sql(*_COMPAT_CHAIN, select="SELECT * FROM cand"),
    "nb_fit": _sql(EV, LATEST, MEANS, LABELED, BAYES, select=_BAYES_COLUMNS),
    "nb_fit_compat": _sql(EV, ALL_EVENTS, MEANS, LABELED, BAYES, select=_BAYES_COLUMNS),
    "nb_classify": _sql(
        EV, LATEST, MEANS, LABELED, BAYES, LIKED.format(source="labeled"), select="SELECT * FROM judged"
    ),
    "chi_square_features": _sql(
        EV,
        LATEST,
        MEANS,
        LABELED,
        _CHI,
        select="""SELECT feature, dof AS degrees_of_freedom, round(statistic, 6) AS statistic,
       round((pow(statistic / dof, 1.0 / 3) - (1 - 2.0 / (9 * dof))) / sqrt(2.0 / (9 * dof)), 6) AS z_score FROM chi""",
    ),
    "cf_nb_recommend": _sql(*_BAYES_CHAIN, *_JUDGED, BAYES_LIST, select="SELECT * FROM nb"),
    "cf_nb_recommend_compat": _sql(
        *_COMPAT_CHAIN, *_JUDGED, BAYES_LIST_COMPAT, select=_labelled("nb", "score")
    ),
    "als_id_index": _sql(
        EV, select=_INDEX_FACTS.format(side="user") + "\nUNION ALL " + _INDEX_FACTS.format(side="item")
    ),
    "hybrid_serve": _HYBRID,
    "hybrid_serve_default": _hybrid(DEFAULT_NUM, chain=_DEFAULT_CHAIN, max_items=PopularityParams().max_items),
    "cf_nb_recommend_default": _sql(
        *_DEFAULT_CHAIN,
        BAYES,
        LIKED.format(source="cand"),
        _asked(DEFAULT_NUM),
        _bayes_list(DEFAULT_NUM),
        select='SELECT "user", item, score, rank FROM nb',
    ),
    # each batch asked alone
    "hybrid_serve_mixed_num": " UNION ALL ".join(
        f"SELECT * FROM ({_hybrid(n, f'{chr(34)}user{chr(34)}, {n} AS num, item, score, rank')})" for n in MIXED_NUMS
    ),
    "hybrid_serve_compat": _sql(
        *_COMPAT_CHAIN,
        *_JUDGED,
        BAYES_LIST_COMPAT,
        VIEWS,
        _prune(POPULAR.max_items),
        _top("pruned", POPULAR.max_items),
        POPULAR_LIST_COMPAT,
        BLENDED,
        select=_labelled("served", "score"),
    ),
    "model_roundtrip": _HYBRID,
    "als_fit_check": _sql(
        EV,
        select="""SELECT side, count(DISTINCT id) AS n, count(DISTINCT id) AS n_ids, 10 AS least, 10 AS most
FROM (SELECT 'user' AS side, "user" AS id FROM ev UNION ALL SELECT 'item', item FROM ev) GROUP BY side""",
    ),
    "als_solved_check": _sql(
        EV, select='SELECT "user", count(DISTINCT item) AS n_ratings, true AS solved FROM ev GROUP BY "user"'
    ),
    "als_lists_check": _sql(
        EV,
        select=f"""SELECT "user", least({NUM}, (SELECT count(DISTINCT item) FROM ev)) AS n, true AS ranks_ok,
       true AS order_ok, true AS products_ok, true AS shares_ok FROM ev GROUP BY "user\"""",
    ),
    "als_batch_check": _sql(
        EV,
        select=f"""SELECT a."user", a.num, least(a.num, k.n) AS n, least(a.num, k.n) AS n_items, CAST(0 AS BIGINT) AS n_different
FROM (SELECT "user", unnest([{", ".join(map(str, MIXED_NUMS))}]) AS num
      FROM (SELECT user_id AS "user" FROM events UNION SELECT c_custkey FROM customer)) a
JOIN (SELECT DISTINCT "user", (SELECT count(DISTINCT item) FROM ev) AS n FROM ev) k ON k."user" = a."user"
UNION ALL
SELECT "user", unnest([{", ".join(map(str, MIXED_NUMS))}]), 0, 0, 0
FROM (SELECT user_id AS "user" FROM events UNION SELECT c_custkey FROM customer)
WHERE "user" NOT IN (SELECT "user" FROM ev)""",
    ),
    "rf_lists_check": 'SELECT DISTINCT user_id AS "user", CAST(0 AS BIGINT) AS outside, true AS total_ok FROM events',
    "rf_nodes_check": _sql(
        EV,
        LATEST,
        MEANS,
        LABELED,
        select="""SELECT CAST(t.range AS INTEGER) AS tree, count(*) AS n_rows, sum(label) AS n_liked,
       CAST(0 AS BIGINT) AS n_different, CAST(0 AS BIGINT) AS n_unsound FROM labeled, range(5) t GROUP BY t.range""",
    ),
    "rf_lists_lengths": _sql(
        *_BAYES_CHAIN,
        ASKED,
        select="""SELECT a."user", count(c.item) AS n_candidates, CAST(0 AS BIGINT) AS n_off
FROM asked a LEFT JOIN cand c ON c."user" = a."user" GROUP BY a."user\"""",
    ),
    "rf_classify_check": _sql(
        EV, LATEST, MEANS, LABELED, select="SELECT label, count(*) AS n, true AS valid FROM labeled GROUP BY label"
    ),
    "model_summaries": _sql(
        *_BAYES_CHAIN,
        VIEWS,
        _top("views", POPULAR.max_items),
        """sizes AS (
  SELECT (SELECT count(*)::VARCHAR FROM nearest) AS n, (SELECT count(*)::VARCHAR FROM likes) AS l,
         (SELECT count(*)::VARCHAR FROM r) AS s, (SELECT count(DISTINCT "user")::VARCHAR FROM ev) AS u,
         (SELECT count(DISTINCT item)::VARCHAR FROM ev) AS i, (SELECT count(*)::VARCHAR FROM top) AS t)""",
        select=f"""SELECT 0 AS position, 'nb' AS model, unnest(['neighbours', 'likes', 'seen', 'classifier', 'weight']) AS name,
       unnest([n, l, s, 'NaiveBayesModel', '2.0']) AS value FROM sizes
UNION ALL SELECT 1, 'als', unnest(['users', 'items', 'rank']), unnest([u, i, '10']) FROM sizes
UNION ALL SELECT 2, 'prt', unnest(['neighbours', 'likes', 'seen', 'classifier', 'weight']),
       unnest([n, l, s, 'RandomForestClassificationModel', '1.0']) FROM sizes
UNION ALL SELECT 3, 'mv', unnest(['top', 'seen', 'max_items']), unnest([t, s, '{POPULAR.max_items}']) FROM sizes""",
    ),
    "stored_models_check": "SELECT unnest(['nb', 'als', 'prt', 'mv']) AS name, CAST(0 AS BIGINT) AS differ",
    "kfold_split": _sql(EV, select=_SPLIT.format(k=_K)),
    "order_kfold_split": _sql(ORDER_EV, select=_SPLIT.format(k=10)),
    "eval_ground_truth": _sql(
        EV,
        select=f"""SELECT CAST(event_id % {_K} AS INTEGER) AS fold, "user", count(*) AS n_ratings,
       count(DISTINCT item) AS n_items, round(sum(rating), 6) AS sum_rating, {NUM} AS num
FROM ev GROUP BY event_id % {_K}, "user\"""",
    ),
    "eval_ground_truth_lists": _sql(
        EV,
        f"""sized AS (
  SELECT *, CAST(event_id % {_K} AS INTEGER) AS fold,
         CAST(ceil(count(*) OVER (PARTITION BY "user", event_id % {_K}) / 4) AS BIGINT) AS parts FROM ev)""",
        """dealt AS (
  SELECT *, CAST(CAST('0x' || substr(md5(CAST(event_id AS VARCHAR)), 1, 8) AS BIGINT) % parts AS INTEGER) AS part FROM sized)""",
        select=f"""SELECT fold, "user", {NUM} AS num, part,
       string_agg(event_id || ':' || item || ':' || CAST(CAST(round(rating, 6) AS DECIMAL(20,6)) AS VARCHAR), ',' ORDER BY event_id) AS ratings
FROM dealt GROUP BY fold, "user", part""",
    ),
    "precision_at_k": _sql(
        EV,
        FOLD_BASE,
        _fold_hits(POPULAR.max_items),
        select=f"""SELECT fold, count(*) AS n_queries, count(*) FILTER (n_recommended > 0) AS n_scored,
       round({_PRECISION}, 9) AS precision FROM hits GROUP BY fold""",
    ),
    "recall_at_k": _sql(
        EV,
        FOLD_BASE,
        _fold_hits(POPULAR.max_items),
        select=f"SELECT fold, count(*) AS n_queries, round({_RECALL}, 9) AS recall FROM hits GROUP BY fold",
    ),
    "precision_at_k_compat": _sql(
        EV,
        FOLD_BASE,
        _fold_hits(2),
        f"""rows AS (
  SELECT fold, count(*) AS n_queries,
         CASE WHEN bool_or(n_recommended = 0) THEN 'NaN'::DOUBLE ELSE round({_PRECISION}, 9) END AS precision
  FROM hits GROUP BY fold)""",
        select=_labelled("rows", "precision"),
    ),
    "precision_at_k_compat_lists": _sql(
        EV,
        FOLD_BASE,
        _fold_hits(POPULAR.max_items, compat=True),
        f"""rows AS (
  SELECT fold, count(*) AS n_queries, round({_RECALL}, 9) AS recall,
         CASE WHEN bool_or(n_recommended = 0) THEN 'NaN'::DOUBLE ELSE round({_PRECISION}, 9) END AS precision
  FROM hits GROUP BY fold)""",
        select=_labelled("rows", "precision"),
    ),
    "precision_unscored": _sql(
        EV,
        FOLD_BASE,
        _fold_hits(2),
        select=f"""SELECT fold, count(*) AS n_queries, count(*) FILTER (n_recommended > 0) AS n_scored,
       round({_PRECISION}, 9) AS precision, round({_RECALL}, 9) AS recall FROM hits GROUP BY fold""",
    ),
    "param_sweep": _sql(
        EV,
        FOLD_BASE,
        *(_fold_hits(n, f"_{i}") for i, n in enumerate(SWEEP_ITEMS)),
        _sweep(len(SWEEP_ITEMS)),
        select=_SWEEP_REPORT,
    ),
    "fold_neighbours": _sql(
        EV,
        FOLD_BASE,
        _fold_pairs(_K, _T),
        *(_fold_nearest(m, n, f"_{m}") for m, n in FOLD_TOPS.items()),
        select="\nUNION ALL ".join(f"{ROUNDED}(SELECT {m} AS min_common, * FROM fnearest_{m})" for m in FOLD_TOPS),
    ),
    "precision_at_k_hybrid": _sql(
        EV,
        FOLD_BASE,
        _fold_pairs(_K, _T),
        FOLD_BAYES,
        _fold_bayes_lists(_T, _N, NUM),
        _hits("fnb", ""),
        select=_FOLD_REPORT + "hits GROUP BY fold",
    ),
    "precision_at_k_blend": _sql(
        EV,
        FOLD_BASE,
        _fold_pairs(_K, _T),
        FOLD_BAYES,
        _fold_bayes_lists(_T, _N, NUM),
        _fold_hits(POPULAR.max_items, "").replace("hits AS (", "hits_popular AS ("),
        FOLD_BLEND,
        _hits("fblend", ""),
        select=_FOLD_REPORT + "hits GROUP BY fold",
    ),
    "param_sweep_neighbours": _sql(
        EV,
        _fold_base(EvalParams().k_fold),
        _fold_pairs(EvalParams().k_fold, min(m for m, _ in SWEEP_NEIGHBOURS)),
        FOLD_BAYES,
        *(
            part
            for i, (m, n) in enumerate(SWEEP_NEIGHBOURS)
            for part in (_fold_bayes_lists(m, n, DEFAULT_NUM, f"_{i}"), _hits(f"fnb_{i}", f"_{i}"))
        ),
        _fold_hits(
            PopularityParams().max_items, f"_{len(SWEEP_NEIGHBOURS)}", k=EvalParams().k_fold, num=DEFAULT_NUM
        ),
        _sweep(len(SWEEP_NEIGHBOURS) + 1),
        select=_SWEEP_REPORT,
    ),
}

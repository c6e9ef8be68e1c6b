"""Queries on element tables of pages, and their SQL, which reads the tags a second time (H1, C14)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from larkspur.operators import elements
from larkspur.plans.base import registered
from larkspur.plans.views import view
from larkspur.scratch import spread

#: Pages by part: labels, lists beside and around them, named elements, pop-ups and accordions, as the part's values have it.
PAGES = """
SELECT p_partkey AS page_id, CASE WHEN p_partkey % 5 = 0 THEN 'CN' ELSE 'US' END AS market,
  '<html><head><title>Ingredients of ' || p_brand || '</title><style>.ingredients { color: red }</style></head><body>' ||
  CASE WHEN p_size % 4 = 0 THEN '<div class="x ingredients-popup"><p>Rose: Aqua, ' || p_name || '</p><ul><li>Tin</li><li>Mica &amp; ' || p_type || '</li></ul></div><div class="ingredients-popup">All of ' || p_brand || '</div>' ELSE '' END ||
  CASE WHEN p_size % 3 = 0 THEN '<section id="Full-Ingredient-List">' || p_type || ' <b>and</b> more of it</section>' WHEN p_size % 3 = 1 THEN '<p data-testid="ingredients">' || p_name || '</p>' ELSE '' END ||
  '<main><div class="box"><h2>' || CASE WHEN p_partkey % 5 = 0 THEN '全成分 ' ELSE 'Ingredients and ' END || p_brand || '</h2>loose text<ul><li>one ' || p_name || '</li><li>two</li></ul><br><p>Water, ' || p_type || '</p><em>four of ' || p_brand || '</em><i>five of ' || p_brand || '</i></div></main>' ||
  CASE WHEN p_size % 2 = 0 THEN '<footer><span>INCI names</span><span>Ingredient notes</span><a href="/x">see ' || p_brand || '</a></footer>' ELSE '' END ||
  '<script>var ingredients = "<p>ingredients</p>";</script>' ||
  CASE p_size % 5 WHEN 0 THEN '<div id="accordion-toggle-How to Use"><div class="markdown">Rub ' || p_name || '</div></div>' WHEN 1 THEN '<button aria-controls="none" title="How to use">x</button><button aria-controls="h" title="How To Use">x</button><div id="h"><p class="a markdown b">Use <b>' || p_type || '</b></p></div>' ELSE '' END ||
  CASE p_size % 6 WHEN 0 THEN '<button aria-controls="i"> Ingredients &amp; Safety </button><div id="i"><div><span class="markdown"> Water </span></div><p class="product-details-accordions-ingredients-disclaimer">Ask ' || p_brand || '</p></div>' WHEN 1 THEN '<div id="accordion-toggle-Ingredients and Safety"><p>nothing</p></div>' ELSE '' END ||
  '</body></html>' AS html
FROM part
"""
#: CTEs over the pages' tags: element (page_id, pre, stop, depth, tag, head) and said(text tokens). Elements end at the first closing tag of their depth.
TAGS = f"""WITH h AS ({PAGES}), tok AS (SELECT page_id, unnest(range(1, len(ts) + 1)) AS i, unnest(ts) AS t FROM (
  SELECT page_id, regexp_extract_all(regexp_replace(html, '(?s)<(script|style)[^>]*>.*?</(script|style)>', '<u></u>', 'g'), '<[^>]*>|[^<]+') AS ts FROM h)),
d AS (SELECT *, starts_with(t, '</') AS closes, starts_with(t, '<') AND NOT starts_with(t, '</') AND NOT starts_with(t, '<br') AS opens,
  sum(CASE WHEN starts_with(t, '</') THEN -1 WHEN starts_with(t, '<') AND NOT starts_with(t, '<br') THEN 1 ELSE 0 END) OVER (PARTITION BY page_id ORDER BY i) AS depth FROM tok),
ends AS (SELECT o.page_id, o.i AS pre, o.depth, o.t AS head, min(c.i) AS stop FROM d o JOIN d c ON o.page_id = c.page_id AND c.i > o.i AND c.closes AND c.depth = o.depth - 1 WHERE o.opens GROUP BY ALL
  UNION ALL SELECT page_id, 0, 0, '<>', max(i) + 1 FROM d GROUP BY page_id),
words AS (SELECT page_id, i, trim(regexp_replace(replace(t, '&amp;', '&'), '\\s+', ' ', 'g')) AS said FROM tok WHERE NOT starts_with(t, '<') AND trim(t) <> ''),
element AS (SELECT e.page_id, pre, stop, depth, head, regexp_extract(head, '^<([a-z0-9]*)', 1) AS tag, coalesce(string_agg(w.said, ' ' ORDER BY w.i), '') AS said
  FROM ends e LEFT JOIN words w ON w.page_id = e.page_id AND w.i > e.pre AND w.i < e.stop GROUP BY ALL)"""
_BLOCKS = TAGS + """, popup AS (SELECT * FROM element WHERE contains(head, 'ingredients-popup')),
inside AS (SELECT p.page_id, p.pre AS popup, x.pre FROM popup p JOIN element x ON x.page_id = p.page_id AND x.pre > p.pre AND x.stop < p.stop AND x.tag IN ('p', 'li')),
label AS (SELECT e.*, (SELECT max(a.pre) FROM element a WHERE a.page_id = e.page_id AND a.pre < e.pre AND a.stop > e.stop) AS parent FROM element e JOIN h USING (page_id)
  WHERE tag IN ('h1', 'h2', 'h3', 'h4', 'h5', 'h6', 'strong', 'b', 'span', 'p', 'div') AND length(said) BETWEEN 1 AND 120 AND CASE WHEN market = 'CN' THEN regexp_matches(said, '全成分|成分|配料|配方') ELSE regexp_matches(said, '(?i)\\b(?:ingredients?|inci)\\b') END),
sibling AS (SELECT l.page_id, x.pre, row_number() OVER (PARTITION BY l.page_id, l.pre ORDER BY x.pre) AS k FROM label l JOIN (SELECT page_id, pre, stop, depth FROM element UNION ALL SELECT page_id, i, i, depth + 1 FROM d WHERE starts_with(t, '<br')) x
  ON x.page_id = l.page_id AND x.pre > l.stop AND x.depth = l.depth AND x.pre < (SELECT p.stop FROM element p WHERE p.page_id = l.page_id AND p.pre = l.parent)),
ancestor AS (SELECT l.page_id, a.pre, row_number() OVER (PARTITION BY l.page_id, l.pre ORDER BY a.pre DESC) AS k FROM label l JOIN element a ON a.page_id = l.page_id AND a.pre < l.pre AND a.stop > l.stop),
picked AS (SELECT page_id, pre, 'popup' AS kind, 1 AS least FROM inside UNION SELECT page_id, pre, 'popup', 1 FROM popup WHERE (page_id, pre) NOT IN (SELECT page_id, popup FROM inside)
  UNION SELECT page_id, pre, 'named', 11 FROM element WHERE regexp_matches(head, '(?i)(id|class|data-testid)="[^"]*ingredient') UNION SELECT page_id, pre, 'label', 11 FROM label
  UNION SELECT page_id, pre, 'near', 11 FROM sibling WHERE k <= 4 UNION SELECT page_id, pre, 'around', 21 FROM ancestor WHERE k <= 4)
SELECT page_id, kind, said AS block FROM picked JOIN element USING (page_id, pre) WHERE length(said) >= least"""


@registered("page_blocks", _BLOCKS)
def page_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """H1: all five kinds of blocks."""
    return elements.blocks(spread(view(spark, sf_dir, PAGES))).select("page_id", "kind", "block")


@registered("page_elements", TAGS + " SELECT page_id, count(*) - 1 + (SELECT count(*) FROM tok t WHERE t.page_id = e.page_id AND starts_with(t.t, '<br')) AS n_elements, max(depth) AS deepest, sum(length(said))::BIGINT AS text_sizes, max(CASE WHEN pre = 0 THEN said END) AS said FROM element e GROUP BY page_id")
def page_elements(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The element table itself: counts, depth by parents, and the sizes of all texts."""
    rows = elements.elements(spread(view(spark, sf_dir, PAGES)))
    depth = F.aggregate("elements", F.array().cast("array<long>"), lambda a, e: F.array_append(a, F.when(e["parent"] < 0, F.lit(0)).otherwise(F.get(a, e["parent"]) + F.when(e["tag"] == "br", 0).otherwise(1)).cast("long")))
    return rows.select("page_id", (F.size("elements") - 1).cast("long").alias("n_elements"), F.array_max(depth).alias("deepest"), F.aggregate("elements", F.lit(0).cast("long"), lambda a, e: a + e["size"]).alias("text_sizes"), "said")


_within = lambda cond: f"(SELECT first(said ORDER BY x.pre) FROM element x WHERE x.page_id = c.page_id AND x.pre > c.pre AND x.stop < c.stop AND {cond})"
_class = lambda name: f"regexp_matches(x.head, 'class=\"(?:[^\"]* )?{name}(?: [^\"]*)?\"')"


@registered("page_accordions", TAGS + f""", ids AS (SELECT *, regexp_extract(head, ' id="([^"]*)"', 1) AS id FROM element WHERE regexp_matches(head, ' id="')),
named AS (SELECT b.page_id, b.pre AS nth, lower(trim(CASE WHEN contains(head, 'title=') THEN regexp_extract(head, 'title="([^"]*)"', 1) ELSE said END)) AS title, regexp_extract(head, 'aria-controls="([^"]*)"', 1) AS id FROM element b WHERE tag = 'button'),
found AS (SELECT page_id, 'how' AS what, 0 AS nth, pre, stop FROM ids WHERE id = 'accordion-toggle-How to Use' UNION ALL SELECT page_id, 'what', 0, pre, stop FROM ids WHERE id = 'accordion-toggle-Ingredients and Safety'
  UNION ALL SELECT page_id, CASE title WHEN 'how to use' THEN 'how' ELSE 'what' END, nth, pre, stop FROM named JOIN ids USING (page_id, id) WHERE title IN ('how to use', 'ingredients and safety', 'ingredients & safety')),
c AS (SELECT * FROM found QUALIFY row_number() OVER (PARTITION BY page_id, what ORDER BY nth, pre) = 1),
t AS (SELECT page_id, what, nullif({_within(_class('markdown'))}, '') AS main, nullif({_within(_class('product-details-accordions-ingredients-disclaimer'))}, '') AS more FROM c)
SELECT h.page_id, a.main AS how_to_use, b.main AS ingredients, b.more AS disclaimer FROM h LEFT JOIN t a ON a.page_id = h.page_id AND a.what = 'how' LEFT JOIN t b ON b.page_id = h.page_id AND b.what = 'what'""")
def page_accordions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """C14: how to use, ingredients and disclaimer of the accordions."""
    return elements.accordions(spread(view(spark, sf_dir, PAGES)))

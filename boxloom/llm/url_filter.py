"""URL filters by a weighted vocabulary and host rules.

An Aho-Corasick automaton finds strict and soft terms in the whole percent-decoded url: host, path, query and
fragment. A term counts only between boundaries (no letter or digit on either side). Soft terms that speak of one
thing are one concept, which weighs what its heaviest term does: forms of a word, or a word in two languages, are
one hit. One strict term, or SOFT_HITS distinct concepts whose weights reach REJECT, block a url. Rules for hosts
and paths come before the vocabulary; the longest that fits decides.
"""

from __future__ import annotations

from collections.abc import Iterator, Mapping
from urllib.parse import unquote

import ahocorasick
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from boxloom.llm.shared import ascii_lower

#: (verdict, host, path): a rule fits its host and all subdomains where the path starts with its own.
RULES = (
    ("block", "com", "/en/"),
    ("allow", "example.com", "/en/7"),
    ("allow", "net", "/de/"),
    ("block", "example.net", "/de/8"),
    ("block", "org", "/es/"),
)
#: Terms that block on their own, in several languages.
STRICT = tuple(
    "casino kasino casinos porn porno pornos xxx viagra cialis jackpot escort escorts hentai tragaperras spielautomaten tragamonedas camgirls payday-loan".split()
)
#: Soft terms by concept: (concept, weight, terms).
VOCABULARY = (
    ("spam", 0.7, "spam spammer spamming"),
    ("adult", 0.7, "adult nude nudes nudity sex erotic erotica erotik erotique erotismo sexy"),
    ("hookup", 0.6, "hookup hookups sexdating flirt"),
    ("dating", 0.5, "dating singles rencontre rencontres citas cams camshow"),
    ("rating", 0.3, "x xx uncensored nsfw"),
    ("cam", 0.4, "cam webcamsex"),
    ("betting", 0.7, "paris-sportifs sportwetten apuestas-deportivas"),
    ("betting", 0.6, "bet bets betting bookmaker bookmakers wette wetten apuesta apuestas pari paris-en-ligne poker slots slot-machine roulette blackjack baccarat"),
    ("pharmacy", 0.6, "pill pills pillen pilule pilules pastilla pastillas steroids levitra xanax tramadol slimming potenzmittel"),
    ("adverts", 0.7, "popunder popunders adserver adservers"),
    ("adverts", 0.6, "ads adclick doubleclick werbung publicidad publicite"),
    ("tracking", 0.5, "track tracker trackers tracking"),
    ("tracking", 0.4, "pixel pixels beacon"),
    ("malware", 0.7, "malware trojan keylogger phishing"),
    ("cracks", 0.6, "warez keygen keygens crack cracked serialz nulled"),
    ("prize", 0.6, "gewinnspiel gewinnspiele sweepstake sweepstakes giveaway lottery loterie loteria"),
    ("prize", 0.5, "win winner gewinn gewinne gagner gagnez gana ganar bonus bono bonos"),
    ("bargain", 0.5, "cheap cheapest billig billiger barato baratos pas-cher free gratis gratuit gratuite gratuits kostenlos"),
    ("bargain", 0.4, "deal deals discount discounts rabatt rabatte descuento descuentos coupon coupons"),
    ("loans", 0.5, "loan loans kredit kredite prestamo prestamos pret-rapide payday"),
    ("loans", 0.4, "credit"),
    ("fakes", 0.5, "replica replicas counterfeit"),
    ("link farm", 0.4, "farm linkfarm backlinks pbn"),
    ("affiliate", 0.4, "affiliate affiliates partnerprogramm"),
    ("clicks", 0.3, "click clicks klick clic"),
    ("offer", 0.3, "offer offers angebot angebote oferta ofertas offre"),
    ("crypto", 0.5, "pump-signals doubler hyip ponzi"),
)
SOFT = {term: weight for _, weight, terms in VOCABULARY for term in terms.split()}
CONCEPTS = {term: concept for concept, _, terms in VOCABULARY for term in terms.split()}
SOFT_HITS, REJECT = 2, 1.0


def host_of(url: Column) -> Column:
    """What follows the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z lower-cased; else empty."""
    return ascii_lower(F.coalesce(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1), F.lit("")))


def path_of(url: Column) -> Column:
    """What follows the host up to ``?``, ``#`` or the end; empty if there is no host part."""
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def rule_for(host: Column, path: Column, rules: tuple = RULES) -> Column:
    """struct(rule, verdict) of the longest rule that fits; null if none does."""
    out = F.lit(None).cast("struct<rule:string,verdict:string>")
    for verdict, at, prefix in sorted(rules, key=lambda r: (len(r[1] + r[2]), r[1] + r[2])):
        fits = ((host == at) | F.endswith(host, F.lit("." + at))) & F.startswith(path, F.lit(prefix))
        out = F.when(fits, F.struct(F.lit(at + prefix).alias("rule"), F.lit(verdict).alias("verdict"))).otherwise(out)
    return out


def build_automaton(strict: tuple, soft: tuple | Mapping[str, float], concepts: Mapping[str, str] = CONCEPTS) -> ahocorasick.Automaton:
    """Finds ``strict`` and ``soft`` terms; soft terms without weights weigh REJECT together when there are SOFT_HITS.

    A term that ``concepts`` does not know is a concept of its own.
    """
    words = ahocorasick.Automaton()
    for term in sorted({*strict, *soft}):
        weight = None if term in strict else soft[term] if isinstance(soft, Mapping) else REJECT / SOFT_HITS
        words.add_word(term, (term, concepts.get(term, term), weight))
    words.make_automaton()
    return words


def weighed_hits(words: ahocorasick.Automaton, text: str) -> tuple[int, int, float]:
    """Numbers of distinct strict terms and soft concepts that stand between boundaries in ``text``, and the concepts' weight."""
    strict, soft = set(), {}
    for end, (term, concept, weight) in words.iter(text):
        start = end - len(term)
        if (start < 0 or not text[start].isalnum()) and (end + 1 == len(text) or not text[end + 1].isalnum()):
            if weight is None:
                strict.add(term)
            else:
                soft[concept] = max(weight, soft.get(concept, 0.0))
    return len(strict), len(soft), round(sum(sorted(soft.values())), 6)


def term_hits(words: ahocorasick.Automaton, text: str) -> tuple[int, int]:
    """Numbers of distinct strict terms and soft concepts that stand between boundaries in ``text``."""
    return weighed_hits(words, text)[:2]


def scan_urls(urls: DataFrame, strict: tuple = STRICT, soft: Mapping[str, float] = SOFT) -> DataFrame:
    """``urls`` (with string column url) plus n_strict, n_soft (int, concepts) and soft_weight (double)."""

    def scan(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        words = build_automaton(strict, soft)
        for b in batches:
            hits = [weighed_hits(words, unquote(u or "").lower()) for u in b["url"]]
            b["n_strict"], b["n_soft"], b["soft_weight"] = ([x[k] for x in hits] for k in range(3))
            yield b

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in urls.schema)
    return urls.mapInPandas(scan, schema + ", n_strict int, n_soft int, soft_weight double")


def judge_urls(pages: DataFrame, strict: tuple = STRICT, soft: Mapping[str, float] = SOFT, rules: tuple = RULES) -> DataFrame:
    """Per row of ``pages``: page_id, host, path, rule, verdict, n_strict, n_soft, soft_weight.

    A null url, or one without ``://``, has empty host and path and fits no rule; a null one has no terms. Percent
    escapes that are no UTF-8 stand for no letter. Rows that repeat a page_id are judged one by one.
    """
    url = F.col("url")
    parts = pages.select("page_id", "url", host_of(url).alias("host"), path_of(url).alias("path"))
    own = F.when((F.col("n_strict") > 0) | ((F.col("n_soft") >= SOFT_HITS) & (F.col("soft_weight") >= REJECT)), "block").otherwise("allow")
    return (
        scan_urls(parts, strict, soft)
        .withColumn("fit", rule_for(F.col("host"), F.col("path"), rules))
        .select("page_id", "host", "path", F.col("fit.rule").alias("rule"), F.coalesce("fit.verdict", own).alias("verdict"), "n_strict", "n_soft", "soft_weight")
    )


def _oracle() -> str:
    def found(term: str) -> str:
        return f"regexp_matches(u, '(^|[^\\p{{L}}\\p{{N}}]){term}($|[^\\p{{L}}\\p{{N}}])')"

    strict = " + ".join(f"cast({found(t)} as int)" for t in STRICT)
    of = {c: [t for t in SOFT if CONCEPTS[t] == c] for c in dict.fromkeys(CONCEPTS.values())}
    soft = ", ".join("greatest(" + ", ".join(f"case when {found(t)} then {SOFT[t]}::double end" for t in terms) + ", null)" for terms in of.values())
    fits = " union all ".join(f"select '{v}' as v, '{h}' as h, '{p}' as p" for v, h, p in RULES)
    return f"""
with a as (
  select page_id, lower(case when contains(url, '%') then url_decode(url) else coalesce(url, '') end) as u,
    case when strpos(url, '://') > 0 then translate(regexp_extract(substr(url, strpos(url, '://') + 3), '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') else '' end as host,
    case when strpos(url, '://') > 0 then regexp_extract(substr(url, strpos(url, '://') + 3), '^[^/?#]*([^?#]*)', 1) else '' end as path
  from pages
), w as (select *, {strict} as n_strict, list_filter([{soft}], lambda x: x is not null) as s from a),
c as (select *, len(s) as n_soft, round(coalesce(list_sum(s), 0), 6) as soft_weight from w),
r as ({fits}),
f as (select c.*, (select arg_max({{'rule': r.h || r.p, 'v': r.v}}, length(r.h || r.p)) from r
       where (c.host = r.h or ends_with(c.host, '.' || r.h)) and starts_with(c.path, r.p)) as fit from c)
select page_id, host, path, fit.rule as rule,
  coalesce(fit.v, case when n_strict > 0 or (n_soft >= {SOFT_HITS} and soft_weight >= {REJECT}) then 'block' else 'allow' end) as verdict,
  cast(n_strict as int) as n_strict, cast(n_soft as int) as n_soft, soft_weight
from f
"""


ORACLE = _oracle()

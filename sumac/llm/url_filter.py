"""URL filters: allow and block rules, and for other URLs logistic regression on hashed character n-grams of host and path.

The model learns on the driver from a small labelled table of URLs (LABELLED, or one that is given; at most MOST rows). Judging runs in
DataFrame functions only: the n-grams' bins index an array of integer weights, so that sums are exact in any order.
"""

from __future__ import annotations

import math
import re
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sumac.llm.text import field

#: Characters of an n-gram, bins of the hash, weights' unit, and the most labelled URLs that are taken.
GRAM, BINS, UNIT, MOST = 4, 4096, 1_000_000, 20_000
#: (verdict, host, path): fits the host and its subdomains where the URL's path starts with the rule's; the longest wins.
RULES = [("block", "net", "/"), ("allow", "example.net", "/en/"), ("block", "example.com", "/de/"), ("allow", "org", "/fr/")]
#: A small labelled table of URLs, written down from common knowledge of the web; those to block are advertising and
#: tracking, gambling, adult, loans, pills, cracks and other spam, in the wording such hosts and paths have.
BLOCKED = """
https://ad.doubleclick.net/ddm/clk/3129;4411 https://pagead2.googlesyndication.com/pagead/js/ads.js https://ib.adnxs.com/getuid?redir https://cdn.taboola.com/libtrc/loader.js
https://widgets.outbrain.com/outbrain.js https://static.criteo.net/js/ld/ld.js https://c.amazon-adsystem.com/aax2/apstag.js https://ads.pubmatic.com/AdServer/js/pwt.js
https://sb.scorecardresearch.com/beacon.js https://cdn.adsafeprotected.com/iasPET.1.js https://s.adroll.com/j/roundtrip.js https://popads.net/banner/click https://propellerads.com/landing/offer
https://trk.clickbank-offers.com/track/aff?id=9 http://click.tracking-server.info/redirect/lp https://adserver.banner-exchange.biz/adview.php http://ads.mobile-clicks.co/impression
https://www.bet365.com/#/HO/ https://www.pokerstars.com/poker/promotions/bonus/ https://www.888casino.com/online-casino-games/slots/ https://www.williamhill.com/betting/en-gb
https://www.jackpotcity.com/free-spins/ http://best-online-casino-bonus.com/slots/no-deposit http://live-roulette-gambling.net/win/real-money https://crypto-casino-betting.io/jackpot
http://free-slots-spins.bet/bonus/claim https://sportsbook-odds-bets.ag/signup/bonus http://lottery-winner-prize.org/claim/prize/now http://mega-jackpot-lotto.info/win
https://www.pornhub.com/view_video.php https://www.xvideos.com/video.512/ https://xhamster.com/categories/amateur https://www.redtube.com/pornstar https://chaturbate.com/female-cams/
http://hot-sexy-cams-live.com/nude/girls http://free-xxx-tube-videos.net/porn/milf http://adult-dating-hookup.xyz/sex/tonight http://escort-girls-nude.club/gallery/xxx
http://teen-cams-porn.top/live/sex http://sexy-singles-date.site/join/hookup http://erotic-massage-escorts.biz/nude
http://cheap-viagra-pills.com/buy/cialis http://canadian-pharmacy-meds.net/order/viagra-online http://buy-tramadol-online-cheap.org/no-prescription http://weight-loss-miracle-pill.com/keto/diet/order
http://discount-pharmacy-rx.biz/buy/xanax http://steroids-buy-online.shop/cheap http://diet-pills-fat-burn.info/order/now http://male-enhancement-pills.co/free-trial
http://payday-loans-fast-cash.com/apply/now http://instant-cash-advance.loan/bad-credit http://make-money-fast-online.biz/earn/daily http://bitcoin-doubler-profit.io/invest/double
http://forex-signals-rich.com/profit/guaranteed http://work-from-home-cash.info/earn/money http://debt-relief-credit-fix.loan/apply http://get-rich-crypto-bot.xyz/invest
http://warez-cracks-keygen.net/download/serial http://free-movie-torrents-hd.to/download/full http://crack-software-serials.org/keygen/free http://nulled-scripts-themes.cc/download
http://mp3-free-downloads.pw/crack http://watch-movies-free-online.stream/full-hd http://game-hacks-cheats.ru/free/generator http://free-giftcards-generator.win/claim
http://replica-watches-rolex.cn/cheap/sale http://cheap-designer-handbags.top/outlet/replica http://fake-diploma-degree.com/buy http://louis-vuitton-outlet-sale.us.com/cheap
http://seo-backlinks-cheap.com/buy/links http://buy-instagram-followers.club/cheap http://traffic-exchange-hits.info/banner/clicks http://link-farm-directory.biz/submit/links
http://account-verify-secure-login.tk/paypal/signin http://you-won-prize-iphone.ga/claim/now http://virus-alert-support.cf/call/now http://psychic-love-spells.online/cheap/reading
""".split()
ALLOWED = """
https://en.wikipedia.org/wiki/Suffix_automaton https://de.wikipedia.org/wiki/Berlin https://www.wikidata.org/wiki/Q42 https://commons.wikimedia.org/wiki/Main_Page https://github.com/apache/spark
https://github.com/python/cpython/issues https://gitlab.com/gitlab-org/gitlab https://docs.python.org/3/library/re.html https://pypi.org/project/numpy/ https://numpy.org/doc/stable/
https://spark.apache.org/docs/latest/ https://kafka.apache.org/documentation/ https://www.postgresql.org/docs/current/sql.html https://developer.mozilla.org/en-US/docs/Web
https://stackoverflow.com/questions/231767/what-does-yield-do https://math.stackexchange.com/questions/11 https://news.ycombinator.com/item?id=1 https://arxiv.org/abs/1706.03762
https://www.nature.com/articles/nature14539 https://www.science.org/journal/science https://pubmed.ncbi.nlm.nih.gov/31452104/ https://journals.plos.org/plosone/ https://www.jstor.org/stable/2331554
https://www.bbc.co.uk/news/world https://www.theguardian.com/science/2020/jan/01/physics https://www.nytimes.com/section/books https://www.lemonde.fr/planete/ https://www.spiegel.de/kultur/
https://elpais.com/cultura/ https://www.reuters.com/world/europe/ https://apnews.com/hub/climate https://www.economist.com/leaders https://www.dw.com/en/science/s-12526
https://www.nasa.gov/missions/webb/ https://www.esa.int/Science_Exploration https://home.cern/science/physics https://www.noaa.gov/weather https://www.usgs.gov/programs/earthquake-hazards
https://www.who.int/health-topics/malaria https://www.cdc.gov/flu/about https://www.nhs.uk/conditions/asthma/ https://www.mayoclinic.org/diseases-conditions https://www.un.org/en/about-us
https://europa.eu/youth/education https://www.gov.uk/browse/driving https://www.loc.gov/collections/ https://www.bl.uk/manuscripts https://www.bnf.fr/fr/collections https://www.dnb.de/DE/Sammlungen
https://www.mit.edu/education/ https://www.stanford.edu/academics/ https://www.ox.ac.uk/admissions https://www.uni-heidelberg.de/de/studium https://www.sorbonne-universite.fr/en https://www.ethz.ch/en/research
https://www.metmuseum.org/art/collection https://www.louvre.fr/en/explore https://www.britishmuseum.org/collection https://www.rijksmuseum.nl/en/stories https://www.museodelprado.es/coleccion
https://www.gutenberg.org/ebooks/1342 https://archive.org/details/texts https://www.britannica.com/topic/history https://plato.stanford.edu/entries/logic/ https://www.merriam-webster.com/dictionary/theory
https://www.weather.gov/forecast https://www.openstreetmap.org/about https://www.nationalgeographic.com/animals https://www.smithsonianmag.com/history/ https://www.rhs.org.uk/plants/garden
https://www.bbcgoodfood.com/recipes/soup https://www.allrecipes.com/recipe/pancakes https://www.seriouseats.com/bread https://www.chefkoch.de/rezepte/ https://www.marmiton.org/recettes/
https://www.ikea.com/gb/en/cat/chairs https://www.bahn.de/service https://www.sncf.com/fr/itineraires https://www.visitnorway.com/places-to-go/ https://www.lonelyplanet.com/spain
https://www.fifa.com/tournaments https://olympics.com/en/athletes https://www.espn.com/soccer/schedule https://www.chess.com/learn https://www.nobelprize.org/prizes/physics/
https://www.city-library.org/opening-hours https://blog.school-garden.net/2019/spring https://forum.woodworkers.co.uk/threads/oak-table https://www.town-council.gov.uk/planning https://shop.bookstore.com/novels
https://www.village-choir.de/termine https://www.mountain-hiking.ch/routen/alpen https://status.hosting-provider.net/incidents https://help.bank-of-town.com/accounts https://www.local-theatre.fr/saison
""".split()
LABELLED = [*((u, 1) for u in BLOCKED), *((u, 0) for u in ALLOWED)]

_URL = r"(?s)^.*?://([^/?#]*)([^?#]*)"
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


@dataclass(frozen=True)
class Model:
    """weights: one whole number for each bin, in millionths; a URL is blocked where their sum and the bias is 0 or more."""

    weights: tuple[int, ...]
    bias: int


def parts(url: str | None) -> tuple[str, str]:
    found = re.match(_URL, url or "")
    return (found[1].translate(str.maketrans(_UPPER, _LOWER)), found[2]) if found else ("", "")


def _bins(url: str) -> list[int]:
    out = []
    for k, part in enumerate(parts(url)):
        codes = [ord(c) for c in f"^{part}$"]
        out += [(codes[i] * 29791 + codes[i + 1] * 961 + codes[i + 2] * 31 + codes[i + 3] + k * 1777) % BINS for i in range(len(codes) - GRAM + 1)]
    return out


def train(labelled: Sequence[tuple[str, int]] = tuple(LABELLED), rounds: int = 60, rate: float = 0.3, decay: float = 1e-4) -> Model:
    """Logistic regression by stochastic gradient steps in the table's order; an empty table gives a model that allows all."""
    if len(labelled) > MOST:
        raise ValueError(f"at most {MOST} labelled URLs")
    weights, bias = [0.0] * BINS, 0.0 if labelled else -1.0
    rows = [(_bins(u), y) for u, y in labelled]
    order = [k * 7919 % len(rows) for k in range(len(rows))] if math.gcd(7919, max(len(rows), 1)) == 1 else list(range(len(rows)))
    for _ in range(rounds):
        for k in order:
            bins, y = rows[k]
            z = bias + sum(weights[b] for b in bins)
            step = rate / math.sqrt(len(bins) + 1) * (y - 1 / (1 + math.exp(-max(-30.0, min(30.0, z)))))
            bias += step
            for b in bins:
                weights[b] += step - rate * decay * weights[b]
    return Model(tuple(round(w * UNIT) for w in weights), round(bias * UNIT))


def _sum(part: Column, number: int, weights: Column) -> Column:
    codes = F.transform(F.split(F.concat(F.lit("^"), part, F.lit("$")), ""), lambda c: F.ascii(c).cast("long"))
    starts = F.when(F.size(codes) >= GRAM, F.sequence(F.lit(0), F.size(codes) - GRAM)).otherwise(F.array().cast("array<int>"))
    code = lambda i, k: F.get(codes, i + k)
    each = F.transform(starts, lambda i: F.get(weights, ((code(i, 0) * 29791 + code(i, 1) * 961 + code(i, 2) * 31 + code(i, 3) + number * 1777) % BINS).cast("int")))
    return F.aggregate(each, F.lit(0).cast("long"), lambda a, x: a + x)


def judge(pages: DataFrame, model: Model, rules: list[tuple[str, str, str]] = RULES, url: str = "url", keep: list[str] | None = None) -> DataFrame:
    """pages with host, path, rule (like ``net/``; null where none fits), verdict (allow or block) and margin (double, the log odds of block).

    A null URL, or one without ``://``, has empty host and path and is judged by the model. Repeated rows stay repeated;
    a column of pages that has the name of a new one is replaced.
    """
    new = ["host", "path", "rule", "verdict", "margin"]
    keep = [c for c in (pages.columns if keep is None else keep) if c.lower() not in new]
    raw = F.coalesce(field(pages, url).cast("string"), F.lit(""))
    split = pages.select(*[field(pages, c) for c in keep], F.translate(F.regexp_extract(raw, _URL, 1), _UPPER, _LOWER).alias("host"), F.regexp_extract(raw, _URL, 2).alias("path"))
    host, path = F.col("host"), F.col("path")
    rule, said = F.lit(None).cast("string"), F.lit(None).cast("string")
    for verdict, h, p in sorted(rules, key=lambda r: (len(r[1]), len(r[2]))):  # a later one, longer, goes before
        fits = ((host == h) | host.endswith("." + h)) & path.startswith(p)
        rule, said = F.when(fits, F.lit(h + p)).otherwise(rule), F.when(fits, F.lit(verdict)).otherwise(said)
    weights = F.array(*[F.lit(w) for w in model.weights]).cast("array<bigint>")
    total = F.lit(model.bias).cast("long") + _sum(host, 0, weights) + _sum(path, 1, weights)
    margin = total / UNIT
    full = split.withColumns({"rule": rule, "margin": margin, "verdict": F.coalesce(said, F.when(margin >= 0, "block").otherwise("allow"))})
    return full.select(*[field(full, c) for c in keep], *new)


def sql(model: Model, rules: list[tuple[str, str, str]] = RULES) -> str:
    """The DuckDB SQL of judge() over ``pages``, without the margin."""
    fits = "".join(
        f"WHEN (host = '{h}' OR ends_with(host, '.{h}')) AND starts_with(path, '{p}') THEN '{h + p}:{v}' " for v, h, p in sorted(rules, key=lambda r: (-len(r[1]), -len(r[2])))
    )
    gram = lambda t, k: f"w[(unicode({t}[i]) * 29791 + unicode({t}[i + 1]) * 961 + unicode({t}[i + 2]) * 31 + unicode({t}[i + 3]) + {k} * 1777) % {BINS} + 1]"
    total = lambda t, k: f"coalesce(list_sum(list_transform(range(1, length({t}) - {GRAM - 2}), lambda i: {gram(t, k)})), 0)"
    return (
        "WITH p AS (SELECT page_id, translate(regexp_extract(coalesce(url, ''), '^.*?://([^/?#]*)([^?#]*)', 1, 's'), '"
        + f"{_UPPER}', '{_LOWER}') AS host, regexp_extract(coalesce(url, ''), '^.*?://([^/?#]*)([^?#]*)', 2, 's') AS path FROM pages), "
        + f"m AS (SELECT [{', '.join(map(str, model.weights))}]::BIGINT[] AS w), "
        + "q AS (SELECT *, '^' || host || '$' AS h, '^' || path || '$' AS t, CASE " + fits + "END AS found FROM p), "
        + f"z AS (SELECT page_id, host, path, found, {model.bias} + {total('h', 0)} + {total('t', 1)} AS total FROM q, m) "
        + "SELECT page_id, host, path, split_part(found, ':', 1) AS rule, coalesce(split_part(found, ':', 2), CASE WHEN total >= 0 THEN 'block' ELSE 'allow' END) AS verdict FROM z"
    )

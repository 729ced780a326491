"""Landed HTML result pages and detail pages to offers.

A task reads each page once and emits the raw strings of its cards by name, which is all that Python does; identifiers,
contracts, dates, defaults and the choice between representations are columns. What is looked for is a table for each source.
"""

from __future__ import annotations

import json
import re
from collections import defaultdict
from collections.abc import Iterator
from functools import cache, lru_cache
from html import unescape
from html.parser import HTMLParser

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from offerloom.functions.scalars import iso_timestamp, lenient_date, relative_date
from offerloom.functions.text import canonical_url, clean_external_id, has_text, masked, slug
from offerloom.functions.values import SOURCE_CODES

VOID = frozenset(("area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "source", "track", "wbr"))
ROOT = "root"

# Where the sources' pages have what a card or a detail page tells. A place is tag, class or attribute
# (with "=" its value, with "*=" a part of it, with "^=" its beginning) and, after "@", the attribute that is read instead of the
# text; of several places the first in the page counts. `cards` are tried in turn; after ">" stands the enclosing element that is the card.
CARDS = {
    "linkedin": {
        "cards": ("div.base-card", "li.jobs-search-results__list-item", "div.job-search-card"),
        "title": ("h3.base-search-card__title", "a.job-card-list__title", "h3.job-card-title"),
        "company": ("h4.base-search-card__subtitle", "a.job-card-container__company-name", "h4.job-card-subtitle"),
        "location": ("span.job-search-card__location", "li.job-card-container__metadata-item", "span.job-card-location"),
        "url": ("a.base-card__full-link@href", "a.job-card-list__title@href"),
        "urn": ("root@data-entity-urn",),
        "contract": ("span.job-search-card__employment-type", "span.job-card-container__employment-type"),
        "date": ("time.job-search-card__listdate@datetime", "time.job-card-container__listed-date@datetime"),
        "said_date": ("time.job-search-card__listdate", "time.job-card-container__listed-date"),
    },
    "hellowork": {
        "cards": ("li[data-id-storage-item-id]", "a[href*=/fr-fr/emplois/]>li"),
        "id": ("root@data-id-storage-item-id",),
        "url": ("a[href*=/emplois/]@href",),
        "title": ("input[name=title]@value",),
        "said_title": ("p.tw-typo-l", "h3", "h2"),
        "company": ("input[name=company]@value",),
        "said_company": ("p.tw-typo-s.tw-inline",),
        "location": ("[data-cy=localisationCard]",),
        "contract": ("[data-cy=contractCard]",),
        "tags": ("div.tw-tag-secondary-s",),
        "date": ("time@datetime",),
        "said_date": ("time",),
    },
    "francetravail": {
        "cards": ("li.result[data-id-offre]", "li.result"),
        "id": ("root@data-id-offre",),
        "url": ("a[href*=/offres/recherche/detail/]@href",),
        "title": ("span.media-heading-title",),
        "said_title": ("h2.media-heading",),
        "company": ("p.subtext",),
        "location": ("p.subtext span",),
        "description": ("p.description",),
        "contract": ("p.contrat",),
        "said_date": ("p.date",),
    },
    "freework": {
        "cards": ("[data-job-id]", "a[href*=/job-mission/]>article,li,div.mb-4,div.shadow"),
        "id": ("root@data-job-id", "root@data-id"),
        "tagged": ("[id^=tags-]@id",),
        "url": ("a[href*=/job-mission/]@href",),
        "title": ("a[href*=/job-mission/]",),
        "said_title": ("h2", "h3"),
        "company": ("[data-company]@data-company",),
        "said_company": (".job-company", ".company", ".font-bold"),
        "location": ("[data-location]", ".job-location", ".location"),
        "contract": ("root@data-contract",),
        "said_contract": ("[data-contract]", ".job-contract", ".contract", "span.tag"),
        "date": ("time@datetime",),
        "said_date": ("time",),
    },
}
DETAILS = {
    "linkedin": {
        "title": ("h1.top-card-layout__title", "h1.jobs-unified-top-card__job-title"),
        "company": ("a.topcard__org-name-link", "span.jobs-unified-top-card__company-name"),
        "location": ("span.topcard__flavor--bullet", "span.jobs-unified-top-card__bullet"),
        "description": ("div.description__text", "div.jobs-description__content"),
        "criteria": ("li.description__job-criteria-item", "li.jobs-unified-top-card__job-insight"),
        "skills": ("span.job-details-skill-match-status-list__skill-name",),
    },
    "francetravail": {
        "title": ("h1", "[itemprop=title]"),
        "company": ("[itemprop=hiringOrganization]",),
        "location": ("[itemprop=jobLocation]",),
        "description": ("[itemprop=description]", ".description"),
    },
}
HOSTS = {"linkedin": "https://www.linkedin.com", "hellowork": "https://www.hellowork.com", "francetravail": "https://candidat.francetravail.fr", "freework": "https://www.free-work.com"}
#: Contract labels that sources A and B write out, and words of source D's labels in the order in which they are tried.
CONTRACTS = {"CDI": "cdi", "CDD": "cdd", "STAGE": "stage", "ALTERNANCE": "alternance", "INTÉRIM": "interim", "INTERIM": "interim", "FREELANCE": "freelance"}
CONTRACT_WORDS = {
    "freelance": ("freelance", "independant", "mission"),
    "alternance": ("alternance", "apprentissage"),
    "interim": ("interim", "temporaire"),
    "stage": ("stage", "internship"),
    "cdd": ("cdd",),
    "cdi": ("cdi",),
}


#: A tag written plainly, without its signs: attributes without a reference, in double quotes or without a value. Elements of raw text but these two go to the parser.
TAG = re.compile(r'(/?)([a-z][a-z0-9]*)((?: [a-zA-Z_][a-zA-Z0-9_:.-]*(?:="[^"<>&]*")?)*)')
ATTRIBUTE = re.compile(r' ([a-zA-Z_][a-zA-Z0-9_:.-]*)(?:="([^"]*)")?')
RAW, PARSED = frozenset(("script", "style")), frozenset(("textarea", "title", "xmp", "iframe", "noembed", "noframes", "noscript", "plaintext"))


@lru_cache(1 << 14)
def _tag(text: str) -> tuple[str, str, dict[str, str], str] | None:
    """Whether it ends, name, attributes and kind of a plain tag, told once for tags that are written alike; nobody changes the attributes."""
    if not (plain := TAG.fullmatch(text)):
        return None
    end, name, attributes = plain.groups()
    told = {k.lower(): v for k, v in ATTRIBUTE.findall(attributes)}
    return None if end and attributes else (end, name, told, _kind(name, told))


def _kind(tag: str, attributes: dict[str, str]) -> str:
    """Tag, class and names of attributes."""
    return "\0".join((tag, attributes.get("class", ""), *attributes))


class _Page(HTMLParser):
    """The elements of a page in order: tag, attributes, number of the parent, number after the last descendant, the first and the
    number after the last of the pieces of text inside, and kind. Pages of plain tags are read without the parser, with the same elements."""

    def __init__(self, html: str, plain: bool = True):
        self.elements: list[list] = []
        self.open: list[int] = []
        self.pieces: list[str] = []
        if not (plain and self._plain(html)):
            super().__init__(convert_charrefs=True)
            self.elements, self.open, self.pieces = [], [], []
            self.feed(html)
            self.close()
        for i in self.open:
            self.elements[i][3], self.elements[i][5] = len(self.elements), len(self.pieces)

    def _plain(self, html: str) -> bool:
        """Read a page of plain tags and texts; false where something else stands between them. The common cases are written out here, as a
        call for each tag would take longer than what it does."""
        raw, elements, stack, pieces = None, self.elements, self.open, self.pieces
        text, *rest = html.split("<")
        if text:
            self.handle_data(unescape(text))
        for one in rest:
            head, closed, text = one.partition(">")
            told = _tag(head) if closed else None
            if told is None:
                return False
            end, tag, attributes, kind = told
            if end:
                if raw not in (None, tag):
                    return False
                raw = None
                if stack and elements[stack[-1]][0] == tag:
                    e = elements[stack.pop()]
                    e[3], e[5] = len(elements), len(pieces)
                else:
                    self.handle_endtag(tag)
            else:
                if raw or tag in PARSED:
                    return False
                if tag in RAW:
                    raw = tag
                n, at = len(elements), len(pieces)
                elements.append([tag, attributes, stack[-1] if stack else -1, n + 1, at, at, kind])
                if tag not in VOID:
                    stack.append(n)
            if text and (text := (text if raw or "&" not in text else unescape(text)).strip()):
                pieces.append(text)
        return raw is None

    def handle_starttag(self, tag: str, attrs: list) -> None:
        n, at = len(self.elements), len(self.pieces)
        attributes = {k: v or "" for k, v in attrs}
        self.elements.append([tag, attributes, self.open[-1] if self.open else -1, n + 1, at, at, _kind(tag, attributes)])
        if tag not in VOID:
            self.open.append(n)

    def handle_endtag(self, tag: str) -> None:
        elements, stack = self.elements, self.open
        if any([elements[i][0] == tag for i in stack]):
            while True:
                e = elements[stack.pop()]
                e[3], e[5] = len(elements), len(self.pieces)
                if e[0] == tag:
                    break

    def handle_data(self, data: str) -> None:
        if piece := data.strip():
            self.pieces.append(piece)

    def text(self, i: int) -> str:
        _, _, _, _, first, last, _ = self.elements[i]
        return " ".join((self.pieces[first] if last - first == 1 else " ".join(self.pieces[first:last])).split())


@cache
def _test(place: str):
    """Whether an element is at a place: a tag, classes, and an attribute."""
    tag, classes, name, how, value = _parts(place)
    if tag and not classes and name is None:
        return lambda e: e[0] == tag
    compare = {None: lambda x: True, "=": value.__eq__, "*=": lambda x: value in x, "^=": lambda x: x.startswith(value)}[how]
    return lambda e: (not tag or e[0] == tag) and (not classes or classes <= set(e[1].get("class", "").split())) and (name is None or (name in e[1] and compare(e[1][name])))


def _parts(place: str) -> tuple:
    tag, classes, name, how, value = re.fullmatch(r"(\w*)((?:\.[\w-]+)*)(?:\[([\w-]+)(?:([*^]?=)([^\]]*))?\])?", place).groups()
    return tag, frozenset(classes.split(".")[1:]), name, how, value


@cache
def _lookups(places: tuple[tuple[str, tuple[str, ...]], ...]) -> tuple[list, list, dict]:
    """Places of the root, all others, and what is known so far of elements by their kind."""
    ways = [(name, k, *place.partition("@")[::2]) for name, ways in places for k, place in enumerate(ways)]
    return [(name, k, read) for name, k, where, read in ways if where == ROOT], [w for w in ways if w[2] != ROOT], {}


def _may_be_at(e: list, places: list) -> list:
    """The places at which elements of a kind are, with a test where an attribute's value decides, and, for places inside others, with
    the test of what is looked for inside."""
    near = []
    for name, k, where, read in places:
        outer, _, inner = where.rpartition(" ")
        tag, classes, attribute, how, _ = _parts(outer or inner)
        if (not tag or e[0] == tag) and classes <= set(e[1].get("class", "").split()) and (attribute is None or attribute in e[1]):
            near.append((name, k, _test(outer or inner) if how else None, _test(inner) if outer else None, read))
    return near


def _found(page: _Page, root: int, places: tuple[tuple[str, tuple[str, ...]], ...]) -> dict[str, list[str]]:
    """What the places in an element hold by name, in the order of the page; a name without a text is left out."""
    own, others, known = _lookups(places)
    elements, out = page.elements, {}
    for name, k, read in own:
        out.setdefault(name, []).append((root, k, read))
    for i in range(root, elements[root][3]):
        e = elements[i]
        near = known.get(e[6])
        if near is None:
            if len(known) > 1 << 14:
                known.clear()
            near = known[e[6]] = _may_be_at(e, others)
        for name, k, at, inner, read in near:
            if at is None or at(e):
                if inner:
                    out.setdefault(name, []).extend([(j, k, read) for j in range(i + 1, e[3]) if inner(elements[j])])
                elif i > root:
                    out.setdefault(name, []).append((i, k, read))
    found = {}
    for name, hits in out.items():
        if texts := [text for i, _, read in (sorted(hits) if len(hits) > 1 else hits) if (text := elements[i][1].get(read, "") if read else page.text(i))]:
            found[name] = texts
    return found


def _cards(page: _Page, ways: tuple[str, ...]) -> list[int]:
    for way in ways:
        place, _, around = way.partition(">")
        at = _test(place)
        hits = [i for i, e in enumerate(page.elements) if at(e)]
        if around:
            links = {page.elements[i][1].get("href", ""): i for i in reversed(hits)}
            hits = []
            for i in sorted(links.values()):
                above = []
                while (i := page.elements[i][2]) >= 0:
                    above.append(i)
                hits += [next((a for a in above if any(_test(p)(page.elements[a]) for p in around.split(","))), above[0] if above else None)]
            hits = [i for i in dict.fromkeys(hits) if i is not None]
        if hits:
            return hits
    return []


def source_codes(spark: SparkSession) -> DataFrame:
    """(source, kind, value, code), the codes by which a source is asked for something."""
    rows = [(source, kind, value, code) for (source, kind), codes in SOURCE_CODES.items() for value, code in codes.items()]
    return spark.createDataFrame(rows, "source string, kind string, value string, code string")


PARTS = "map<string,array<string>>"


def _extracted(pages: DataFrame, roots, places: dict[str, tuple[str, ...]]) -> DataFrame:
    wanted = tuple(places.items())

    def extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Parts are put into flat columns: nested Python values would be looked at one by one again."""
        for batch in batches:
            pages, positions, parts, names, ends, texts = [], [], [0], [], [0], []
            for key, html in zip(*[batch.column(c).to_pylist() for c in ("page_id", "html")], strict=True):
                page = _Page(f"<{ROOT}>{html or ''}</{ROOT}>")
                for i, root in enumerate(roots(page)):
                    pages.append(key)
                    positions.append(i)
                    for name, held in _found(page, root, wanted).items():
                        names.append(name)
                        texts += held
                        ends.append(len(texts))
                    parts.append(len(names))
            held = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(texts, pa.string()))
            told = pa.MapArray.from_arrays(pa.array(parts, pa.int32()), pa.array(names, pa.string()), held)
            yield pa.RecordBatch.from_arrays([pa.array(pages, pa.int64()), pa.array(positions, pa.int32()), told], ["page_id", "pos", "parts"])

    return pages.select(F.col("page_id").cast("long"), "html").mapInArrow(extract, f"page_id long, pos int, parts {PARTS}")


def cards(pages: DataFrame, source: str) -> DataFrame:
    """(page_id, pos, parts) of the cards on landed HTML pages; parts has what each name was found to be, in page order."""
    spec = CARDS[source]
    return _extracted(pages, lambda page: _cards(page, spec["cards"]), {k: v for k, v in spec.items() if k != "cards"})


def part(*names: str) -> Column:
    """The first text of the first of the names that has one."""
    return F.coalesce(*[F.try_element_at(F.try_element_at("parts", F.lit(n)), F.lit(1)) for n in names])


def _lookup(c: Column, values: dict[str, str]) -> Column:
    return F.element_at(F.create_map(*[F.lit(x) for kv in values.items() for x in kv]), c)


def written_contract(c: Column) -> Column:
    """X1 of sources A and B: the label is one of CONTRACTS."""
    return _lookup(F.upper(F.btrim(c)), CONTRACTS)


def named_contract(c: Column) -> Column:
    """X1 of source C: what the label contains first in this order."""
    text = F.upper(c)
    return F.when(text.contains("CDI"), "cdi").when(text.contains("CDD"), "cdd").when(text.contains("INTÉRIM") | text.contains("MIS"), "interim").when(text.contains("ALTERNANCE"), "alternance")


def worded_contract(c: Column) -> Column:
    """X1 of source D: the first family of which a word stands in the label."""
    words = F.split(slug(c), "-")
    out = F.when(F.lit(False), F.lit(""))
    for family, names in CONTRACT_WORDS.items():
        out = out.when(F.arrays_overlap(words, F.array(*[F.lit(n) for n in names])), family)
    return out


def detail_contract(c: Column) -> Column:
    """X1 of a detail page's criteria."""
    text = F.lower(c)
    has = lambda *words: F.greatest(*[text.contains(w) for w in words], F.lit(False))
    return F.when(has("cdi", "full-time", "temps plein"), "cdi").when(has("cdd", "contract"), "cdd").when(has("stage", "internship"), "stage").when(has("alternance", "apprenticeship"), "alternance")


def detail_level(c: Column) -> Column:
    text = F.lower(c)
    has = lambda *words: F.greatest(*[text.contains(w) for w in words], F.lit(False))
    return F.when(has("entry", "junior", "débutant"), "junior").when(has("senior", "confirmé"), "senior").when(has("mid", "intermédiaire"), "mid")


def _offer(rows: DataFrame, source: str, own_id: Column, url: Column, title: Column, company: Column, location: Column, contract: Column, posted_at: Column, description: Column | None = None) -> DataFrame:
    rows = rows.select(
        "page_id",
        "pos",
        F.concat(F.lit(f"{source}_"), own_id).alias("external_id"),
        F.lit(source).alias("source"),
        url.alias("url"),
        title.alias("title"),
        company.alias("company"),
        F.coalesce(location, F.lit("France")).alias("location"),
        (F.lit(None).cast("string") if description is None else description).alias("description"),
        contract.alias("contract_type"),
        posted_at.alias("posted_at"),
    )
    return rows.where(has_text(F.col("external_id")) & has_text(F.col("title")) & has_text(F.col("company")))


def card_offers_a(pages: DataFrame, as_of: Column) -> DataFrame:
    """S3: neither title nor company masked; the id is the URL's last number, else the URN's; contracts as written."""
    rows = cards(pages, "linkedin").where(~masked(part("title")) & ~masked(part("company")))
    in_url, in_urn = F.regexp_extract(part("url"), r"-(\d+)(?:\?|$)", 1), F.regexp_extract(part("urn"), r"jobPosting:(\d+)", 1)
    # a URN is looked into only if there is a URL
    own = F.coalesce(F.nullif(in_url, F.lit("")), F.when(part("url").isNotNull(), F.nullif(in_urn, F.lit(""))))
    date = F.coalesce(iso_timestamp(part("date")), relative_date(F.lower(part("said_date")), as_of))
    return _offer(rows, "linkedin", own, F.coalesce(part("url"), F.concat(F.lit(HOSTS["linkedin"] + "/jobs/view/"), own)), part("title"), part("company"), part("location"), written_contract(part("contract")), date)


def card_offers_b(pages: DataFrame, as_of: Column) -> DataFrame:
    """Hidden fields before visible text; older cards tell place and contract in tags: the first that ends in two to five digits
    or begins with five, and the first that is a contract label."""
    rows = cards(pages, "hellowork")
    tags = F.coalesce(F.try_element_at("parts", F.lit("tags")), F.array().cast("array<string>"))
    placed = F.try_element_at(F.filter(tags, lambda t: t.rlike(r"\d{2,5}$|^\d{5}")), F.lit(1))
    labelled = F.try_element_at(F.filter(tags, lambda t: F.upper(t).isin(*CONTRACTS)), F.lit(1))
    own = part("id")
    url = F.coalesce(part("url"), F.concat(F.lit("/fr-fr/emplois/"), own, F.lit(".html")))
    url = F.when(url.startswith("/"), F.concat(F.lit(HOSTS["hellowork"]), url)).otherwise(url)
    date = F.coalesce(iso_timestamp(part("date")), relative_date(part("said_date"), as_of))
    contract = F.coalesce(written_contract(part("contract")), written_contract(labelled))
    company = F.coalesce(part("company", "said_company"), F.lit("Non spécifié"))
    return _offer(rows, "hellowork", own, url, part("title", "said_title"), company, F.coalesce(part("location"), placed), contract, date)


def card_offers_c(pages: DataFrame, as_of: Column) -> DataFrame:
    """The id from the attribute, else from the link; "company - place" cut at the first dash, else the place is the span."""
    rows = cards(pages, "francetravail")
    own = F.coalesce(part("id"), F.nullif(F.regexp_extract(part("url"), r"/detail/([A-Z0-9]+)", 1), F.lit("")))
    both = F.split(part("company"), " - ", 2)
    dashed = part("company").contains(" - ")
    company = F.when(dashed, F.btrim(both[0])).when(part("location").isNotNull(), F.btrim(F.replace(part("company"), part("location"), F.lit("")), F.lit(" -")))
    location = F.when(dashed, F.btrim(F.try_element_at(both, F.lit(2)))).otherwise(part("location"))
    company = F.coalesce(F.nullif(company, F.lit("")), F.lit("Entreprise confidentielle"))
    url = F.concat(F.lit(HOSTS["francetravail"] + "/offres/recherche/detail/"), own)
    return _offer(rows, "francetravail", own, url, part("title", "said_title"), company, location, named_contract(part("contract")), relative_date(part("said_date"), as_of), part("description"))


def structured_jobs(pages: DataFrame) -> DataFrame:
    """(page_id, rank, pos, job) of the job-shaped objects, as JSON, at any depth: those of the embedded app data (rank 0),
    then the JobPosting nodes of JSON-LD (rank 1). Of objects that tell the same the first stays; what is no JSON has none."""

    def walk(value, is_job, seen: set, out: list) -> None:
        todo = [value]
        while todo:
            x = todo.pop()
            if isinstance(x, dict):
                mark = is_job(x)
                if mark and mark not in seen:
                    seen.add(mark)
                    out.append(x)
                todo += reversed(list(x.values()))
            elif isinstance(x, list):
                todo += reversed(x)

    def app_job(x: dict):
        title, url = x.get("title") or x.get("name"), x.get("url") or x.get("href") or x.get("path")
        own = x.get("id") or x.get("jobId") or x.get("identifier")
        return (str(own or ""), title, str(url or "")) if isinstance(title, str) and (isinstance(url, str) or isinstance(own, str | int)) else None

    def posting(x: dict):
        kinds = x.get("@type")
        return (str(x.get("identifier") or x.get("@id") or ""), str(x.get("url") or x.get("title") or "")) if "JobPosting" in (kinds if isinstance(kinds, list) else [kinds]) else None

    forms = ((r'(?is)<script[^>]*\bid=["\']?__NUXT_DATA__\b[^>]*>(.*?)</script', app_job), (r'(?is)<script[^>]*application/ld\+json[^>]*>(.*?)</script', posting))

    def extract(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            rows = []
            for key, html in zip(frame["page_id"], frame["html"], strict=True):
                for rank, (form, is_job) in enumerate(forms):
                    seen, out = set(), []
                    for block in re.findall(form, html or ""):
                        try:
                            walk(json.loads(block), is_job, seen, out)
                        except ValueError:
                            continue
                    rows += [(key, rank, i, json.dumps(x)) for i, x in enumerate(out)]
            yield pd.DataFrame(rows, columns=["page_id", "rank", "pos", "job"])

    return pages.select("page_id", "html").mapInPandas(extract, "page_id long, rank int, pos int, job string")


def app_identifier(pages: DataFrame) -> DataFrame:
    """(page_id, own_id) of the posting in a page's reference-encoded app data: an array whose objects name places in it."""
    data = F.try_parse_json(F.regexp_extract("html", r'(?is)<script[^>]*\bid=["\']?__NUXT_DATA__\b[^>]*>(.*?)</script', 1))
    rows = pages.select("page_id", data.alias("payload")).select("page_id", F.expr("try_variant_get(payload, '$', 'array<variant>')").alias("cells"))
    cells = rows.where("cells is not null").select("page_id", F.posexplode("cells").alias("at", "cell"))
    named = cells.select("page_id", "at", F.expr("try_variant_get(cell, '$[\"@context\"]', 'int')").alias("context"), F.expr("try_variant_get(cell, '$.id', 'int')").alias("id")).where("context is not null and id is not null")
    value = cells.select(F.col("page_id").alias("p"), F.col("at").alias("i"), F.expr("try_variant_get(cell, '$', 'string')").alias("value"), F.expr("schema_of_variant(cell)").alias("kind")).where("kind in ('STRING', 'BIGINT')")
    context, own = value.alias("c"), value.alias("o")
    met = named.join(context, (F.col("page_id") == F.col("c.p")) & (F.col("context") == F.col("c.i"))).where("c.value = '/contexts/JobPosting'")
    met = met.join(own, (F.col("page_id") == F.col("o.p")) & (F.col("id") == F.col("o.i"))).select("page_id", "at", clean_external_id(F.col("o.value"), "freework").alias("own_id")).where("own_id is not null")
    return met.groupBy("page_id").agg(F.min_by("own_id", "at").alias("own_id"))


def _told(*paths: str) -> Column:
    """The first of the paths in `job` that holds a text, a number or an object's value."""
    return F.coalesce(*[F.nullif(F.get_json_object("job", p), F.lit("")) for p in paths])


def card_offers_d(pages: DataFrame) -> DataFrame:
    """Embedded app data, JSON-LD, or rendered cards: the first of these that gives a page a valid offer counts.

    The URL must be a canonical one of the source (T27); the id is the object's own, else the URL's last part.
    """
    scalar = lambda c: F.when(~c.rlike(r"^[\[{]"), c)
    place = F.coalesce(F.get_json_object("job", "$.jobLocation[0]"), _told("$.location", "$.jobLocation"))
    inside = lambda *keys: F.coalesce(*[F.nullif(F.get_json_object(place, f"$.{k}"), F.lit("")) for k in keys])
    address = F.nullif(F.concat_ws(", ", *[inside(f"address.{k}") for k in ("postalCode", "addressLocality", "addressRegion")]), F.lit(""))
    told = structured_jobs(pages).select(
        "page_id",
        "rank",
        "pos",
        scalar(F.coalesce(_told("$.identifier.value", "$.identifier.@id"), _told("$.id", "$.jobId", "$.identifier", "$['@id']"))).alias("own"),
        scalar(_told("$.url", "$.href", "$.path", "$['@id']")).alias("link"),
        _told("$.title", "$.name").alias("title"),
        F.coalesce(_told("$.company.name", "$.company.label", "$.hiringOrganization.name", "$.hiringOrganization.label", "$.organization.name"), scalar(_told("$.company", "$.hiringOrganization", "$.organization"))).alias("company"),
        F.coalesce(scalar(place), inside("label", "shortLabel", "name", "addressLocality"), scalar(inside("address")), address).alias("location"),
        _told("$.employmentType", "$.contractType", "$.contract", "$.type").alias("contract"),
        _told("$.datePosted", "$.publishedAt", "$.publicationDate", "$.createdAt").alias("date"),
    )
    shown = cards(pages, "freework").select(
        "page_id",
        F.lit(2).alias("rank"),
        "pos",
        part("id", "tagged").alias("own"),
        part("url").alias("link"),
        part("title", "said_title").alias("title"),
        part("company", "said_company").alias("company"),
        part("location").alias("location"),
        part("contract", "said_contract").alias("contract"),
        part("date", "said_date").alias("date"),
    )
    rows = told.unionByName(shown)
    link = F.when(F.col("link").startswith("/"), F.concat(F.lit(HOSTS["freework"]), F.col("link"))).otherwise(F.col("link"))
    url = canonical_url(link, ("www.free-work.com", "free-work.com"), r"^/fr/tech-it/.+/job-mission/[A-Za-z0-9][A-Za-z0-9_-]*$|^/.*job-mission/[A-Za-z0-9][A-Za-z0-9_-]*$")
    rows = rows.withColumn("url", url).where(F.col("url").isNotNull())
    own = F.coalesce(clean_external_id(F.col("own"), "freework"), clean_external_id(F.regexp_extract("url", "([^/]+)$", 1), "freework"))
    valid = _offer(
        rows.withColumn("pos", F.struct("rank", "pos")),
        "freework",
        own,
        F.col("url"),
        F.btrim("title"),
        F.coalesce(F.nullif(F.btrim("company"), F.lit("")), F.lit("Non spécifié")),
        F.nullif(F.btrim("location"), F.lit("")),
        worded_contract(F.col("contract")),
        lenient_date(F.col("date")),
    )
    best = F.min("pos.rank").over(Window.partitionBy("page_id"))
    return valid.withColumn("best", best).where("pos.rank = best").drop("best").withColumn("pos", F.col("pos.pos"))


def detail_pages(pages: DataFrame, source: str) -> DataFrame:
    """(page_id, title, company, location, description, contract_type, experience_level, skills) of plain detail pages.

    Of the criteria the last that names a contract, or a level, decides.
    """
    rows = _extracted(pages, lambda page: [0], DETAILS[source])
    none = F.array().cast("array<string>")
    criteria = F.coalesce(F.try_element_at("parts", F.lit("criteria")), none)
    last = lambda read: F.try_element_at(F.filter(F.transform(criteria, read), lambda x: x.isNotNull()), F.lit(-1))
    nobody = "Unknown" if source == "linkedin" else "Entreprise confidentielle"
    return rows.select(
        "page_id",
        F.coalesce(part("title"), F.lit("Unknown")).alias("title"),
        F.coalesce(part("company"), F.lit(nobody)).alias("company"),
        F.coalesce(part("location"), F.lit("France")).alias("location"),
        part("description").alias("description"),
        last(detail_contract).alias("contract_type"),
        last(detail_level).alias("experience_level"),
        F.coalesce(F.try_element_at("parts", F.lit("skills")), none).alias("skills"),
    )

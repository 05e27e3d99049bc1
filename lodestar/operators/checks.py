"""The five checks as joins and filters over nodes, properties and values.

A check takes a ``Session`` and returns findings; ``CHECKS`` lists them and may
be extended.  Joins are on (doc_id, identifier), never on doc_id alone, so a
large document spreads.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.identifiers import GRAMMAR, REGISTRY_PREFIXES, abbreviate, is_bare_uuid, is_checked_term, is_ctid, is_lower, is_v4, looks_like_iri, registry_tail, vocab_prefix
from ..sources.vocabulary import ALIGNMENT, Vocabulary
from .flatten import flatten, properties_of, values_of
from .joins import spread_join
from .tables import kept

CTID = "ceterms:ctid"
# Properties and classes with a rule of their own.
VERSION_PROPERTIES = ("ceterms:latestVersion", "ceterms:nextVersion", "ceterms:previousVersion")
DOCUMENTED_PAIR = ("ceasn:isChildOf", "ceasn:CompetencyFramework")
#: Identifiers that a message names at most.
SHOWN = 10
COMPETENCY, FRAMEWORK, IS_PART_OF = "ceasn:Competency", "ceasn:CompetencyFramework", "ceasn:isPartOf"

FINDING = "doc_id string, code string, severity string, entity string, property string, value string, message string, rule struct<citation:string,url:string,retrieved:string>"
#: Properties whose values may name an entity, and paths of outermost entities, which no value has as its target.
ENTITIES = "has_entities OR inverse IS NOT NULL"
OUTERMOST = r"^\$(\.@graph)?(\[[0-9]+\])?$"
_SUPPLIED = "node_id string, known array<string>, source string"


@dataclass
class Session:
    """Nodes of the documents under check, the vocabulary, and what was supplied beside them."""

    nodes: DataFrame
    vocab: Vocabulary
    supplied: DataFrame  # _SUPPLIED, one row for each id
    supplied_sources: list[str]  # the first few, for messages
    supplied_count: int = 0
    _references: DataFrame | None = None

    @property
    def properties(self) -> DataFrame:
        return self.vocab.property_table(self.nodes.sparkSession)

    def references(self, wanted: str | None = None) -> DataFrame:
        """Values of declared properties that name an entity, with what they resolve to; of the properties that ``wanted`` holds for (none given: of all, written to a table once).

        ``t_ord`` is null if no node of the document has the id (the first in
        document order counts); ``s_source`` names a supplied document that has it.
        """
        if wanted is None:
            self.keep_references()
        found = self._resolved(wanted) if self._references is None else self._references
        return found.join(F.broadcast(self.properties.where(wanted or ENTITIES)), "prop")  # a few thousand terms

    def keep_references(self) -> None:
        """Resolve all references once, to a table: for several checks.  A single check resolves what it reads."""
        if self._references is None:
            found = self._resolved(ENTITIES)
            self._references = found if self.supplied_count else kept(found)  # with supplied documents, a table is below already

    def _resolved(self, wanted: str) -> DataFrame:
        """Each reference met with its target; ids that very many references name (in a document, or among what is supplied) are spread.

        What follows from the key is not sent with it: a reference's kind and text, and the label of what has the id.
        """
        nodes = self.nodes.where("error IS NULL")
        own = nodes.where("node_id IS NOT NULL").select("doc_id", F.concat(F.lit("i"), "node_id").alias("ref"), F.col("ord").alias("turn"), F.lit(None).cast("string").alias("t_own"), F.col("known").alias("t_known"))
        within = nodes.where(~F.col("path").rlike(OUTERMOST)).select("doc_id", F.concat(F.lit("p"), "path").alias("ref"), (-F.col("ord")).alias("turn"), F.col("label").alias("t_own"), F.col("known").alias("t_known"))
        # Ids are mostly there once, so that nothing is gained by combining them before they move (and sorting them for it).
        targets = own.unionAll(within).repartition("doc_id", "ref").groupBy("doc_id", "ref").agg(F.min("turn").alias("turn"), *(F.min_by(c, "turn").alias(c) for c in ("t_own", "t_known")))
        names = self.properties.where(wanted).select("prop")
        ref = F.when(F.col("kind") == "str", F.concat(F.lit("i"), "text")).otherwise(F.concat(F.lit("p"), "target"))
        unnamed = F.when(F.col("node_id").isNull(), F.col("label"))
        v = values_of(self.nodes).where("kind != 'other'").join(F.broadcast(names), "prop").select("doc_id", "node_id", unnamed.alias("unnamed"), "known", "prop", ref.alias("ref"))
        met = spread_join(v, targets, ["doc_id", "ref"])
        is_text, text = F.col("ref").startswith("i"), F.expr("substring(ref, 2)")
        said, there = F.when(is_text, text), F.col("turn").isNotNull()
        found = met.select("doc_id", F.coalesce("node_id", "unnamed").alias("label"), "node_id", "known", "prop", F.when(is_text, "str").otherwise("nested").alias("kind"), said.alias("text"), F.abs("turn").alias("t_ord"), F.when(there, F.coalesce("t_own", said)).alias("t_label"), "t_known")
        if not self.supplied_count:
            return found.withColumns({"s_known": F.lit(None).cast("array<string>"), "s_source": F.lit(None).cast("string")})
        # Only what the document does not define is looked up, by a key that is null for the rest.
        open_ = F.when(F.col("t_ord").isNull() & (F.col("kind") == "str"), F.col("text"))
        found = kept(found).withColumn("open", open_)
        side = self.supplied.select(F.col("node_id").alias("open"), F.col("known").alias("s_known"), F.col("source").alias("s_source"))
        asked = spread_join(found.where("open IS NOT NULL"), side, ["open"])
        return asked.unionByName(found.where("open IS NULL"), allowMissingColumns=True).drop("open")


# Where the published rules stand, and when they were read.
CTID_URL = "https://credreg.net/ctdl/ctid"
HANDBOOK_URL = "https://credreg.net/ctdl/handbook"
RFC_4122_URL = "https://www.rfc-editor.org/rfc/rfc4122"
SCHEMA_URLS = {"ceasn": "https://credreg.net/ctdlasn/schema/encoding/json", "ceterms": "https://credreg.net/ctdl/schema/encoding/json"}
CONTEXT_URLS = {"ceasn": "https://credreg.net/ctdlasn/schema/context/json", "ceterms": "https://credreg.net/ctdl/schema/context/json"}
RETRIEVED = "2026-08-06"
POLICY_URL = "README.md (Checks)"


def _rule(citation: str | Column, url: str | Column = POLICY_URL, retrieved: str = "-") -> Column:
    as_col = lambda x: F.lit(x) if isinstance(x, str) else x
    return F.struct(as_col(citation).alias("citation"), as_col(url).alias("url"), F.lit(retrieved).alias("retrieved"))


def of_vocabulary(urls: dict[str, str], term: Column) -> Column:
    """The address for the vocabulary of a term."""
    return F.when(vocab_prefix(term) == "ceasn", urls["ceasn"]).otherwise(urls["ceterms"])


_CTID_RULE = ("About the CTID: structure", CTID_URL, RETRIEVED)
_URI_RULE = ("About the CTID: a resource's URI ends in its CTID", CTID_URL, RETRIEVED)


def _encoding(*parts: str | Column, term: str = "prop", urls: dict[str, str] = SCHEMA_URLS) -> Column:
    """A rule of the schema encoding (or the context) that declares ``term``."""
    return _rule(F.concat(F.lit("Schema encoding: "), *(F.lit(p) if isinstance(p, str) else p for p in parts)), of_vocabulary(urls, F.col(term)), RETRIEVED)


def _say(*parts: str | Column) -> Column:
    return F.concat(*(F.lit(p) if isinstance(p, str) else p for p in parts))


def _findings(df: DataFrame, code: str | Column, severity: str | Column, prop: str | Column, value: Column, message: Column, rule: Column) -> DataFrame:
    as_col = lambda x: F.lit(x) if isinstance(x, str) else x
    return df.select("doc_id", as_col(code).alias("code"), as_col(severity).alias("severity"), F.col("label").alias("entity"), as_col(prop).alias("property"), value.alias("value"), message.alias("message"), rule.alias("rule"))


def _cases(df: DataFrame, cases: list[tuple[Column, str, str, Column, Column]], prop: Column, value: Column) -> DataFrame:
    """One finding for each case (condition, code, severity, message, rule) that holds."""
    found = F.array_compact(F.array(*(F.when(c, F.struct(F.lit(code).alias("code"), F.lit(sev).alias("severity"), msg.alias("message"), rule.alias("rule"))) for c, code, sev, msg, rule in cases)))
    each = df.withColumns({"_p": prop, "_v": value}).select("doc_id", "label", "_p", "_v", F.explode(found).alias("f"))
    return _findings(each, F.col("f.code"), F.col("f.severity"), F.col("_p"), F.col("_v"), F.col("f.message"), F.col("f.rule"))


def ctid_format(s: Session) -> DataFrame:
    """Check 1: CTIDs, and registry URIs anywhere."""
    v, is_text = F.col("text"), F.col("kind") == "str"
    shaped, bare = is_text & is_ctid(v), is_text & is_bare_uuid(v)
    structure, of_uri = _rule(*_CTID_RULE), _rule(*_URI_RULE)
    t, is_ctid_prop = F.col("tail"), F.col("prop") == CTID
    malformed = F.when(is_bare_uuid(t), _say("A registry URI whose CTID lacks its ce- prefix")).otherwise(_say("A registry URI that does not end in a CTID"))
    own = registry_tail(F.col("node_id"))
    values = values_of(s.nodes).where(is_ctid_prop | is_text).withColumns({"tail": F.when(is_text, registry_tail(v)), "own": F.when(is_ctid_prop & is_text, own)}).where(is_ctid_prop | F.col("tail").isNotNull())
    own = F.col("own")
    found = _cases(
        values,
        [
            (is_ctid_prop & ~is_text, "CTID_MALFORMED", "ERROR", _say("A CTID is text: ", GRAMMAR), structure),
            (is_ctid_prop & bare, "CTID_BARE_UUID", "ERROR", _say("A UUID without its ce- prefix; a CTID is ", GRAMMAR), structure),
            (is_ctid_prop & is_text & ~shaped & ~bare, "CTID_MALFORMED", "ERROR", _say("Not a CTID: ", GRAMMAR), structure),
            (is_ctid_prop & shaped & ~is_lower(v), "CTID_UPPERCASE", "WARNING", _say("Upper case in a CTID"), _rule("RFC 4122: UUIDs are written in lower case", RFC_4122_URL, RETRIEVED)),
            (is_ctid_prop & shaped & ~is_v4(v), "CTID_NOT_UUIDV4", "WARNING", _say("The version or variant digit is not that of UUID v4"), structure),
            (t.isNotNull() & ~is_ctid(t), "REGISTRY_URI_MALFORMED", "ERROR", malformed, of_uri),
            (own.isNotNull() & is_ctid(own) & shaped & (v != own), "CTID_URI_MISMATCH", "ERROR", _say("The CTID ", v, " is not the one in the @id, ", own), of_uri),
        ],
        F.col("prop"),
        v,
    )
    ids = s.nodes.where("node_id IS NOT NULL").select("doc_id", "label", F.col("node_id").alias("text")).withColumn("tail", registry_tail(v)).where(t.isNotNull() & ~is_ctid(t))
    return found.unionAll(_findings(ids, "REGISTRY_URI_MALFORMED", "ERROR", "@id", v, malformed, of_uri))


def identifier_kind(s: Session) -> DataFrame:
    """Check 2: what stands where an identifier belongs."""
    v = F.col("text")
    bare, ctid = is_bare_uuid(v), is_ctid(v)
    coerced = _encoding("the context types ", F.col("prop"), " as @id", urls=CONTEXT_URLS)
    values = values_of(s.nodes).where("kind = 'str'").join(F.broadcast(s.properties), "prop").where("id_coerced AND has_entities")
    return _cases(
        values,
        [
            (bare, "REF_BARE_UUID", "ERROR", _say("A bare UUID where an IRI belongs, such as ", REGISTRY_PREFIXES[0], "<CTID>"), coerced),
            (~bare & ctid, "REF_BARE_CTID", "WARNING", _say("A bare CTID where an IRI belongs, such as ", REGISTRY_PREFIXES[0], "<CTID>"), _rule(*_URI_RULE)),
            (~bare & ~ctid & ~looks_like_iri(v), "REF_NOT_IRI", "WARNING", _say("Neither an IRI nor a blank node identifier"), coerced),
        ],
        F.col("prop"),
        v,
    )


def references(s: Session) -> DataFrame:
    """Check 3: references that the document does not define."""
    v = F.col("text")
    open_ = s.references("id_coerced AND has_entities").where("kind = 'str' AND t_ord IS NULL")
    blank, iri, held = v.startswith("_:"), looks_like_iri(v), F.col("s_source").isNotNull()
    n = s.supplied_count
    named = ", ".join(s.supplied_sources) + ", ..." * (n > len(s.supplied_sources))
    missed = f". None of the {n} document{'s' * (n != 1)} supplied ({named}) declares it" if n else ". Supplying the document that declares it would settle this"
    as_what = F.when(F.size("s_known") > 0, _say("typed [", F.array_join("s_known", ", "), "]")).otherwise(_say("without a class of the vocabulary"))
    return _cases(
        open_,
        [
            (blank, "REF_UNRESOLVED_BNODE", "ERROR", _say("No node of this document has this blank node identifier"), _rule("Handbook: blank node identifiers are local to a document", HANDBOOK_URL, RETRIEVED)),
            (~blank & iri & held, "REF_RESOLVED_SUPPLIED", "INFO", _say("Found in ", F.col("s_source"), ", ", as_what), _rule("Policy: supplied documents settle references and are not checked")),
            (~blank & iri & ~held, "REF_OUTSIDE_PAYLOAD", "UNVERIFIABLE", _say("Not defined in this document, and nothing is fetched", missed), _rule("Policy: no network")),
        ],
        F.col("prop"),
        v,
    )


def undeclared_terms(s: Session) -> DataFrame:
    """Classes and properties that the vocabulary does not declare."""
    spark = s.nodes.sparkSession
    classes = F.broadcast(s.vocab.class_table(spark).select(F.col("term").alias("type")))
    typed = s.nodes.where("error IS NULL").select("doc_id", "label", F.explode("types").alias("type")).where(is_checked_term(F.col("type")))
    t, p = F.col("type"), F.col("prop")
    undeclared = lambda what, x: _rule(_say("Schema encoding of ", vocab_prefix(x), f" declares no such {what}"), of_vocabulary(SCHEMA_URLS, x), RETRIEVED)
    unknown_class = _findings(typed.join(classes, "type", "left_anti"), "UNKNOWN_CLASS", "WARNING", "@type", t, _say("The vocabulary declares no such class"), undeclared("class", t))
    props = properties_of(s.nodes)
    known = F.broadcast(s.properties)
    unknown_prop = _findings(props.where(is_checked_term(p)).join(known, "prop", "left_anti"), "UNKNOWN_PROPERTY", "WARNING", p, F.lit("-"), _say("The vocabulary declares no such property"), undeclared("property", p))
    return unknown_class.unionAll(unknown_prop)


def domains(s: Session) -> DataFrame:
    """Properties of nodes of other classes than they are declared for."""
    p, types = F.col("prop"), F.array_join("known", ", ")
    outside = properties_of(s.nodes).join(F.broadcast(s.properties), "prop").where((F.size("known") > 0) & (F.size("domain") > 0) & ~F.arrays_overlap("known", "domain_below"))
    return _findings(outside, "DOMAIN_VIOLATION", "ERROR", p, _say("@type=[", types, "]"), _say(p, " is not declared for [", types, "]"), _encoding(p, " has domain ", abbreviate(F.col("domain"))))


def _below(s: Session, term: str) -> Column:
    return F.array(*map(F.lit, s.vocab.below([term]))).cast("array<string>")


def ranges(s: Session) -> DataFrame:
    """References to entities of other classes than they are declared for."""
    p = F.col("prop")
    refs = s.references("has_entities AND NOT universal")
    refs = refs.withColumns({"h_known": F.coalesce("t_known", "s_known"), "h_label": F.coalesce("t_label", "text")})
    off = refs.where((F.size("h_known") > 0) & ~F.arrays_overlap("h_known", "range_below")).withColumn("both", F.array_sort(F.array_intersect(F.array_intersect("known", "h_known"), "dropped")))
    concept = F.col("scheme_bound") & F.arrays_overlap("h_known", _below(s, ALIGNMENT))
    version = p.isin(*VERSION_PROPERTIES) & (F.size("both") > 0)
    child = (p == DOCUMENTED_PAIR[0]) & F.array_contains("h_known", DOCUMENTED_PAIR[1])
    shown = F.when(F.col("kind") == "str", F.col("text")).otherwise(F.col("h_label"))
    origin = F.when(F.col("s_source").isNotNull(), _say(" (read from ", F.col("s_source"), ")")).otherwise(F.lit(""))
    ranged = _encoding(p, " has range ", abbreviate(F.col("range")))
    cls = F.get("both", F.lit(0))
    return _cases(
        off,
        [
            (concept, "CONCEPT_RANGE_CONFLICT", "INFO", _say(p, " is ranged on concepts and this is a ", ALIGNMENT, ", as other properties of its schemes are", origin), _encoding(p, " draws on ", F.array_join("target_scheme", ", "), " like ", F.array_join(F.slice("siblings", 1, 3), ", "))),
            (~concept & version, "VERSION_RANGE_CONFLICT", "INFO", _say(p, " may start from a ", cls, " and not end at one", origin), _encoding(p, " leaves out of its range ", abbreviate(F.col("dropped")))),
            (~concept & ~version & child, "RANGE_DOCS_CONFLICT", "INFO", _say(p, " is not ranged on ", DOCUMENTED_PAIR[1], ", but published guidance uses it so", origin), _rule("Published guidance against the schema encoding", SCHEMA_URLS["ceasn"], RETRIEVED)),
            (~concept & ~version & ~child, "RANGE_VIOLATION", "ERROR", _say(F.col("h_label"), " is typed [", F.array_join("h_known", ", "), "], outside the range of ", p, origin), ranged),
        ],
        p,
        shown,
    )


def frameworks(s: Session) -> DataFrame:
    """Competencies that are part of no framework at hand; of the frameworks a message names the first few, and how many more there are is counted."""
    is_competency, is_framework = (F.arrays_overlap("known", _below(s, c)) for c in (COMPETENCY, FRAMEWORK))
    own = s.nodes.where(F.col("node_id").isNotNull() & is_framework).select("doc_id", "node_id").distinct()
    held = s.supplied.where(is_framework).select("node_id")
    beside = [r[0] for r in held.orderBy("node_id").limit(SHOWN).collect()]
    n_beside = held.count() if len(beside) == SHOWN else len(beside)
    counted = own.join(held.withColumn("both", F.lit(1)), "node_id", "left") if beside else own.withColumn("both", F.lit(None).cast("int"))
    first = own.withColumn("place", F.row_number().over(W.partitionBy("doc_id").orderBy("node_id"))).where(F.col("place") <= SHOWN).groupBy("doc_id").agg(F.array_sort(F.collect_list("node_id")).alias("own"))  # SHOWN at most
    own = kept(first.join(counted.groupBy("doc_id").agg((F.count("*") - F.count("both")).alias("n_own")), "doc_id"))
    stray = kept(s.references(f"prop = '{IS_PART_OF}' AND ({ENTITIES})").where((F.col("kind") == "str") & is_competency & F.col("t_ord").isNull() & F.col("s_source").isNull()).select("doc_id", "label", "text"))
    texts = lambda xs: F.array(*map(F.lit, xs)).cast("array<string>")
    seen = spread_join(stray, own, ["doc_id"]).withColumns({"all": F.slice(F.array_sort(F.array_union(F.coalesce("own", texts([])), texts(beside))), 1, SHOWN), "n_all": F.coalesce("n_own", F.lit(0)) + n_beside}).where("n_all > 0")
    where = "this document or those supplied" if beside else "this document"
    left = F.col("n_all") - F.size("all")
    more = F.when(left > 0, F.format_string(" and %d more%s", left, F.when(F.col("own").isNull(), " supplied").otherwise(""))).otherwise("")
    return _findings(seen, "ISPARTOF_FRAMEWORK_MISMATCH", "WARNING", IS_PART_OF, F.col("text"), _say(f"No framework in {where} has this identifier; there is ", F.array_join("all", ", "), more), _rule("Handbook: a competency and its framework share a graph", HANDBOOK_URL, RETRIEVED))


def domain_and_range(s: Session) -> DataFrame:
    """Check 4: undeclared terms, domains, ranges, and competencies of no framework at hand."""
    return undeclared_terms(s).unionAll(domains(s)).unionAll(ranges(s)).unionAll(frameworks(s))


def inverses(s: Session) -> DataFrame:
    """Check 5: declared inverses between two entities of one document.

    Whether a target states the inverse, and whether it names the subject there, are
    questions of membership: an anti-join on (document, target, inverse, subject) leaves the
    references that are not answered, a join on (document, target, inverse) tells
    which of them meet a property at all.  No list travels with a reference.
    """
    p, inv = F.col("prop"), F.col("inverse")
    refs = s.references("inverse IS NOT NULL").where("node_id IS NOT NULL AND t_ord IS NOT NULL").select("doc_id", "label", "node_id", "prop", "inverse", "kind", "text", "t_ord", "t_label")
    asked = F.broadcast(s.properties.where("inverse IS NOT NULL").select("inverse").distinct())
    stated = properties_of(s.nodes).select("doc_id", F.col("ord").alias("t_ord"), F.col("prop").alias("inverse"), "vals").join(asked, "inverse")
    named = stated.select("doc_id", "t_ord", "inverse", F.explode("vals").alias("v")).where("v.kind = 'str'").select("doc_id", "t_ord", "inverse", F.col("v.text").alias("node_id"))
    open_ = kept(refs.join(named, ["doc_id", "t_ord", "inverse", "node_id"], "left_anti"))
    met = spread_join(open_, stated.select("doc_id", "t_ord", "inverse", F.lit(True).alias("stated")), ["doc_id", "t_ord", "inverse"])
    text = F.when(F.col("kind") == "str", F.col("text")).otherwise(F.col("t_label"))
    rule = _encoding(p, " is declared the inverse of ", inv)
    return _cases(
        met,
        [
            (F.col("stated").isNull(), "INVERSE_ONE_DIRECTION", "INFO", _say(F.col("t_label"), " does not state ", inv, "; one direction is enough"), rule),
            (F.col("stated").isNotNull(), "INVERSE_MISMATCH", "ERROR", _say(F.col("t_label"), " states ", inv, " and does not name ", F.col("node_id")), rule),
        ],
        p,
        text,
    )


CHECKS: list[Callable[[Session], DataFrame]] = [ctid_format, identifier_kind, references, domain_and_range, inverses]


def supplied_entities(documents: DataFrame, vocab: Vocabulary) -> DataFrame:
    """Identified entities of supplied documents (doc_id, raw, source, set_ord): of one id, the first document's first node; blank nodes do not count."""
    nodes = flatten(documents, vocab).where("error IS NULL AND node_id IS NOT NULL AND NOT startswith(node_id, '_:')")
    named = nodes.join(documents.select(F.col("doc_id").cast("string").alias("doc_id"), "source", "set_ord"), "doc_id")
    return named.groupBy("node_id").agg(F.min_by(F.struct("known", "source"), F.struct("set_ord", "ord")).alias("e")).select("node_id", "e.known", "e.source")


def screened(documents: DataFrame, vocab: Vocabulary) -> tuple[DataFrame, DataFrame]:
    """Documents that can be read, and (doc_id, error) of those set aside: for neighbours that may be missing."""
    refused = flatten(documents, vocab).where("error IS NOT NULL").select("doc_id", "error")
    return documents.join(refused.select("doc_id"), "doc_id", "left_anti"), refused


def session(documents: DataFrame, vocab: Vocabulary, supplied: DataFrame | None = None) -> Session:
    """Flatten ``documents`` (doc_id, raw) once, to a table, and, beside them, ``supplied`` (doc_id, raw, source, set_ord); a supplied document that cannot be read fails the run."""
    spark = documents.sparkSession
    nodes = kept(flatten(documents, vocab).drop("label")).withColumn("label", F.coalesce("node_id", "path"))
    if supplied is None:
        return Session(nodes, vocab, spark.createDataFrame([], _SUPPLIED), [])
    broken = flatten(supplied, vocab).where("error IS NOT NULL").limit(1).collect()
    if broken:
        raise ValueError(f"supplied document {broken[0]['doc_id']}: {broken[0]['error']}")
    sources = [r[0] for r in supplied.orderBy("set_ord").select("source").limit(SHOWN).collect()]
    return Session(nodes, vocab, kept(supplied_entities(supplied, vocab)), sources, supplied.count())


def every(s: Session) -> DataFrame:
    """The findings of all checks; a finding may be there twice."""
    s.keep_references()
    out = None
    for check in CHECKS:
        out = check(s) if out is None else out.unionAll(check(s))
    return out


def validate(s: Session) -> DataFrame:
    """All findings, each once."""
    return every(s).dropDuplicates()


def _told_apart(s: Session, *shown: str) -> DataFrame:
    """The columns ``shown`` of all findings, each once: what is not shown is told apart by 128 bits of hash, as its texts are not asked for."""
    rest = [c for c in ("code", "severity", "entity", "property", "value", "message", "rule") if c not in shown]
    return every(s).select(*shown, F.xxhash64(*rest).alias("_a"), F.xxhash64(F.lit(1), *reversed(rest)).alias("_b")).dropDuplicates().select(*shown)


def validated(s: Session) -> DataFrame:
    """All findings without their messages and rules, each as often as ``validate`` has it."""
    return _told_apart(s, "doc_id", "code", "severity", "entity", "property", "value")


def severities(s: Session) -> DataFrame:
    """doc_id, severity of all findings, each once."""
    return _told_apart(s, "doc_id", "severity")

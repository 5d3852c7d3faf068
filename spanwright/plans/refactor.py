"""Whole run over a corpus: matches, context, guards, edits and logs."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import rules
from ..functions import spans as S
from ..functions import texts as T
from ..operators import changelog as L
from ..operators import context as C
from ..operators import match as M
from ..operators import ordered, quality
from ..operators import rewrite as R

Guard = Callable[[Column], Column]


def locate(path: str, text: str, comments: bool = True, strings: bool = True, guards: list[Guard] = (),
           scopes: bool = True) -> C.Step:
    """Line and, if wanted, comment, string and scope of the matches of source files.

    The guards drop matches before scopes are looked for; ``scopes`` are needed
    for a log only.  The scope goes by the kind of file: machine descriptions
    name their patterns, definition files have no scopes, all others are read
    as C.
    """
    md, definitions = F.col(path).endswith(".md"), F.col(path).endswith(".def")
    c_text = F.when(md | definitions, "").otherwise(C.blanked(F.col(text), C.ANNOTATION))
    md_text = F.when(md, F.col(text)).otherwise("")
    keep_c = F.transform("found", lambda m: m.withField("c_scope", m["scope"]))
    choose = F.transform("found", lambda m: m.withField(
        "scope", F.when(md, m["scope"]).when(~definitions, m["c_scope"])).dropFields("c_scope"))
    steps = [C.with_line(text)]
    if comments:
        steps.append(C.with_comment(text))
    if strings:
        steps.append(C.with_string(text))
    if guards:
        steps.append(lambda df: df.withColumn("found", M.filtered(F.col("found"), *guards)))
    if not scopes:
        return C.chain(*steps, lambda df: df.withColumn("found", F.transform(
            "found", lambda m: m.withField("scope", F.lit(None).cast("string")))))
    return C.chain(
        *steps,
        lambda df: df.withColumn("__c", c_text).withColumn("__md", md_text),
        C.with_scope("__c", rules.C_SCOPES, rules.C_LINE_SCOPES, use_lines=~md & ~definitions),
        lambda df: df.withColumn("found", keep_c),
        C.with_scope("__md", rules.MD_SCOPES),
        lambda df: df.withColumn("found", choose).drop("__c", "__md"))


@dataclass(frozen=True)
class Phrase:
    """Log sentence for the rules of one kind, for one name and for many."""
    rules: list[str]
    one: str
    many: str


@dataclass(frozen=True)
class Refactoring:
    """Rules, what they must not touch, and how the log tells it."""
    rules: list[R.Template]
    phrases: list[Phrase]
    exempt: list[str] = field(default_factory=list)
    reject: list[Guard] = field(default_factory=list)
    skip_comments: bool = True
    skip_strings: bool = True
    once: bool = False

    def guards(self, path: str) -> list[Guard]:
        found: list[Guard] = list(self.reject)
        if self.skip_comments:
            found.append(lambda m: m["in_comment"])
        if self.skip_strings:
            found.append(lambda m: m["in_string"])
        if self.exempt:
            exempt = F.lit(False)
            for name in self.exempt:
                exempt = exempt | (F.col(path) == name) | F.col(path).endswith(f"/{name}")
            found.append(lambda m: exempt)
        return found


def _line_in(lines: list[str]) -> Guard:
    return lambda m: T.stripped(m["line"]).isin(lines)


def _names(templates: list[R.Template]) -> list[str]:
    return [t.name for t in templates]


# How the logs tell the changes.
CFG = Refactoring(
    rules.CFG_MACROS + rules.CFG_FIELD_RULES,
    [Phrase([n for n in _names(rules.CFG_MACROS) if not n.startswith("FOR_")],
            "Remove usage of {1} macro.", "Remove uses of macros: {1}."),
     Phrase([n for n in _names(rules.CFG_MACROS) if n.startswith("FOR_")],
            "Added cfun->cfg argument to usage of {1} macro.",
            "Added cfun->cfg argument to uses of macros: {1}."),
     Phrase(_names(rules.CFG_FIELD_RULES), "Drop leading x_ from usage of {1} field.",
            "Drop leading x_ from uses of macros: {1}.")],
    rules.CFG_EXEMPT_FILES)


def said(text: str, templates: list[str]) -> list[Phrase]:
    """The same sentence whatever was hit."""
    return [Phrase(templates, text, text)]


SYMTAB = Refactoring(
    [rules.SYMTAB_MEMBER, rules.SYMTAB_CAST],
    said("Update for conversion of symtab types to a true class hierarchy.", ["member", "cast"]),
    reject=[lambda m: (m["rule"] == "cast") & (_line_in(rules.SYMTAB_NEEDED_CASTS)(m)
                                               | M.line_has(m, "(intptr_t)"))],
    skip_comments=False, skip_strings=False, once=True)
RENAMED_SYMTAB = said("Rename symtab_node_base to symtab_node.", ["rename"])
RENAMED_STATEMENTS = said('Replace "gimple" typedef with "gimple *".', ["rename"])
RENAMED_CLASSES = said("Rename gimple subclass types.", ["rename"])
WRAPPED_OPTIONS = said("Wrap option usage in GCC_OPTION macro.", [])


def refactor(corpus: DataFrame, path: str, text: str, what: Refactoring, log: bool = True) -> DataFrame:
    """Texts with ``edited`` and ``hits``, and ``problem``.  Without a ``log``
    the hits have no scopes."""
    candidates = F.lit(False)
    for rule in what.rules:
        candidates = candidates | F.col(text).rlike(rule.pattern)
    empty = F.array().cast("array<struct<scope:string,rule:string>>")
    untouched = (corpus.where(~F.coalesce(candidates, F.lit(False))).withColumn("edited", F.col(text))
                 .withColumn("hits", empty).withColumn("problem", F.lit(None).cast("string")))
    done = R.rewrite_guarded(corpus.where(candidates), path, text, what.rules,
                             locate(path, "edited", what.skip_comments, what.skip_strings, what.guards(path), log),
                             once=what.once)
    return done.unionByName(untouched)


def rename_once(corpus: DataFrame, path: str, text: str, names: dict[str, str], not_after: str = "",
                reject: list[Guard] = (), exempt: list[str] = (), code_only: bool = True, log: bool = True) -> DataFrame:
    """Types renamed in one pass; the new names are not matched again.
    Without a ``log`` the hits have no scopes."""
    what = Refactoring([rules.rename_rule(names, not_after)], [], list(exempt), list(reject),
                       code_only, code_only)
    placed = corpus.transform(R.with_rule_edits(text, what.rules)).transform(
        locate(path, text, code_only, code_only, what.guards(path), log))
    return _edited(placed, text)


def _edited(placed: DataFrame, text: str) -> DataFrame:
    return (placed.withColumn("edited", S.splice(F.col(text), F.col("found")))
            .withColumn("hits", F.transform("found", lambda m: F.struct(
                m["scope"].alias("scope"), m["rule"].alias("rule"))))
            .drop("found"))


def rename_statements(corpus: DataFrame, path: str, text: str) -> DataFrame:
    """Statement typedefs to pointers, with the lines that must stay."""
    return rename_once(
        corpus, path, text, rules.STATEMENT_RENAMES, ".",
        [_line_in(rules.STATEMENT_EXCLUDED_LINES), lambda m: M.line_ends(m, ": public gimple"),
         lambda m: M.line_is(m, "  gimple")], rules.STATEMENT_EXEMPT_FILES)


def wrap_options(corpus: DataFrame, path: str, text: str, names: DataFrame,
                 macro: str = rules.OPTION_MACRO) -> DataFrame:
    """Uses of the options ``names(name)`` wrapped in a macro, where they are code."""
    table = names.where("name IS NOT NULL").distinct().select(
        F.col("name").alias("old"), F.concat(F.lit(f"{macro} ("), F.col("name"), F.lit(")")).alias("new"))
    found = R.with_name_edits(corpus, path, text, table, f"{macro} (")
    placed = found.transform(locate(path, text))
    exempt = F.lit(False)
    for name in rules.OPTION_EXEMPT_FILES:
        exempt = exempt | F.col(path).endswith(name)
    guards = [lambda m: M.line_starts(m, "int"), lambda m: M.line_has(m, "opt_for_fn"),
              lambda m: m["in_comment"], lambda m: m["in_string"] & ~F.col(path).endswith(".md"), M.line_defines,
              lambda m: F.substring(m["line"], F.lit(1), (m["start"] - m["line_start"]).cast("int")).endswith(
                  rules.OPTION_ATTRIBUTE),
              lambda m: ~M.only_under(F.col(path), m["matched"], rules.OPTION_PLACES), lambda m: exempt]
    return _edited(placed.withColumn("found", M.filtered(F.col("found"), *guards)), text)


SCOPE_ORDERS = {
    "first": lambda: F.min("at"),
    "last": lambda: F.max("at"),
    "last_descending": lambda: -F.max("at"),
}


def change_logs(edited: DataFrame, path: str, dirs: DataFrame, phrases: list[Phrase],
                header: Column, intro: Column, scope_order: str = "last") -> tuple[DataFrame, DataFrame]:
    """Logs per owner folder, in parts, from texts with ``hits``, and the
    entries of files without owner.

    Scopes of a file appear by their first or last hit, with a sentence for
    each kind of rule that hit them; a text repeated in the folder is
    shortened.  A phrase without rules speaks for all.
    """
    hits = S.unnest(edited, [path], "hits", "h", "at").select(path, "at", "h.scope", "h.rule")
    told = None
    for i, phrase in enumerate(phrases):
        mine = hits.where(F.col("rule").isin(phrase.rules)) if phrase.rules else hits
        said_ = L.name_sentences(mine, [path, "scope"], "rule", phrase.one, phrase.many).select(
            path, "scope", F.struct(F.lit(i).alias("at"), F.col("text")).alias("said"))
        told = said_ if told is None else told.unionByName(said_)
    # A scope has at most one sentence per phrase.
    texts = told.groupBy(path, "scope").agg(F.sort_array(F.collect_list("said")).alias("said")).select(
        path, "scope", F.array_join(F.transform("said", lambda x: x["text"]), "  ").alias("text"))
    places = hits.groupBy(F.col(path).alias("__path"), F.col("scope").alias("__scope")).agg(
        SCOPE_ORDERS[scope_order]().alias("place"))
    entries = texts.join(places, (F.col(path) == F.col("__path")) & F.col("scope").eqNullSafe(F.col("__scope"))
                         ).drop("__path", "__scope")
    placed = L.owners(entries, path, dirs)
    homeless = placed.where("problem IS NOT NULL")
    numbered = ordered.dense_order(quality.sound(placed), ["owner_dir", path, "place", "scope"], "ord")
    short = L.likewise(numbered, ["owner_dir"], "ord", "text")
    lines = L.entry_lines(short, ["owner_dir"], "rel_path", "scope", "ord", "short")
    return L.directory_logs(lines, "owner_dir", "ord", "entry", header, intro), homeless

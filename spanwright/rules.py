"""Rule dimensions: the lists that tell the operators what to look for."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .operators.context import ScopeRule
from .operators.match import identifier
from .operators.rewrite import Template


def rename_table(spark: SparkSession, names: dict[str, str]) -> DataFrame:
    """``rule_id, old, new``."""
    rows = [(i + 1, old, new) for i, (old, new) in enumerate(names.items())]
    return spark.createDataFrame(rows, "rule_id bigint, old string, new string")


def name_table(spark: SparkSession, names: list[str], column: str = "name") -> DataFrame:
    return spark.createDataFrame([(n,) for n in names], f"{column} string")


def rename_rule(names: dict[str, str], not_after: str = "", swallow_blank: bool = True) -> Template:
    """Short rename list as one rule; a blank after a new name in `` *`` goes."""
    table = F.create_map(*[F.lit(x) for pair in names.items() for x in pair])

    def renamed(m: Column) -> Column:
        new = F.element_at(table, m["g1"])
        return F.concat(new, F.when(F.lit(swallow_blank) & new.endswith(" *"), "").otherwise(m["g2"]))

    guard = f"(?<![{not_after}])" if not_after else ""
    return Template("rename", guard + identifier(names) + "( ?)", renamed, 2)


# ---------------------------------------------------------------------------
# Patterns that find the scope of a place in C, in order of
# priority, and those that look at the line of the place only.
# ---------------------------------------------------------------------------
_NAME = "([_a-zA-Z][_a-zA-Z0-9]*?)"
C_SCOPES = [
    ScopeRule(rf"(?dms)^{_NAME} \((.*?)\)", needs=(" (",)),
    ScopeRule(rf"(?dms)^([_A-Za-z0-9 ]+\s+\**?){_NAME} \(", "{2}", 2, (" (",)),
    ScopeRule(rf"(?dms)([_a-zA-Z][^\n]*?)::{_NAME}\s+\((?:.*?)\)\n\{{", "{1}::{2}", 2, ("::", ")\n{")),
    ScopeRule(r"(?dms)^#define ([_a-zA-Z0-9]+)\(.*?\)\s+\\\n", needs=("#define", "\\\n")),
    ScopeRule(rf"(?dms)^struct\s+{_NAME}\s*\{{\s*$", "struct {1}", needs=("struct", "{")),
    ScopeRule(rf"(?dms)^struct\s+{_NAME}$", "struct {1}", needs=("struct",)),
    ScopeRule(rf"(?dms)\s+{_NAME}\s*\(", needs=("(",)),
    ScopeRule(rf"(?dms)^struct\s+{_NAME}\s+:\s+public\s+$", needs=("struct", "public")),
]
# \G starts each match where the one before ended: as the patterns start with
# any text, this finds the same matches without trying each place of a line.
C_LINE_SCOPES = [
    ScopeRule(rf"\G(.+?)\s+{_NAME}\s*\(", "{2}", 2, ("(",)),
    ScopeRule(rf"\G(.+?)\s+{_NAME}\s*;", "{2}", 2, (";",)),
    ScopeRule(rf"([_a-zA-Z][^\n]*?)::{_NAME}\s+\((?:.*?)\)", "{1}::{2}", 2, ("::", "(")),
]
MD_SCOPES = [ScopeRule(r'(?dms)\n\([_a-zA-Z][_a-zA-Z0-9]*?\s+"([^"]*)"', needs=("\n(",))]

# Macro uses and what they expand to.
_NOT_AFTER_NAME = "(?<=[^_0-9a-zA-Z>])"
_END = "(?=[^_0-9a-zA-Z])"
CFG_MACROS = [
    Template("ENTRY_BLOCK_PTR", f"ENTRY_BLOCK_PTR{_END}", "cfun->cfg->entry_block_ptr"),
    Template("EXIT_BLOCK_PTR", f"EXIT_BLOCK_PTR{_END}", "cfun->cfg->exit_block_ptr"),
    Template("basic_block_info", f"{_NOT_AFTER_NAME}basic_block_info{_END}", "cfun->cfg->basic_block_info"),
    Template("n_basic_blocks", f"{_NOT_AFTER_NAME}n_basic_blocks{_END}", "cfun->cfg->n_basic_blocks"),
    Template("n_edges", f"{_NOT_AFTER_NAME}n_edges{_END}", "cfun->cfg->n_edges"),
    Template("last_basic_block", f"{_NOT_AFTER_NAME}last_basic_block{_END}", "cfun->cfg->last_basic_block"),
    Template("label_to_block_map", f"{_NOT_AFTER_NAME}label_to_block_map{_END}", "cfun->cfg->label_to_block_map"),
    Template("profile_status", f"{_NOT_AFTER_NAME}profile_status{_END}", "cfun->cfg->profile_status"),
    Template("BASIC_BLOCK", rf"{_NOT_AFTER_NAME}BASIC_BLOCK \((.+)\)", "cfun->cfg->get_bb ({1})", 1),
    Template("SET_BASIC_BLOCK", rf"{_NOT_AFTER_NAME}SET_BASIC_BLOCK \((.+), (.+)\)", "cfun->cfg->set_bb ({1}, {2})", 2),
    Template("FOR_EACH_BB", r"FOR_EACH_BB \(([^,\n]+)\)", "FOR_EACH_BB ({1}, cfun->cfg)", 1),
    Template("FOR_ALL_BB", r"FOR_ALL_BB ?\(([^,\n]+)\)", "FOR_ALL_BB ({1}, cfun->cfg)", 1),
    Template("FOR_EACH_BB_REVERSE", r"FOR_EACH_BB_REVERSE \(([^,\n]+)\)", "FOR_EACH_BB_REVERSE ({1}, cfun->cfg)", 1),
]

# Fields and what they are called without x_.
CFG_FIELDS = [
    ("x_entry_block_ptr", "entry_block_ptr"),
    ("x_exit_block_ptr", "exit_block_ptr"),
    ("x_basic_block_info", "basic_block_info"),
    ("x_n_basic_blocks", "n_basic_blocks"),
    ("x_n_edges", "n_edges"),
    ("x_last_basic_block", "last_basic_block"),
    ("x_label_to_block_map", "label_to_block_map"),
    ("x_profile_status", "profile_status"),
]
CFG_FIELD_RULES = [Template(old, f"->{old}", f"->{new}") for old, new in CFG_FIELDS]
# Files the macro rules leave alone.
CFG_EXEMPT_FILES = ["basic-block.h", "gcc.dg/tree-ssa/20041122-1.c", "gcc.target/ia64/pr49303.c"]

# Symbol-table types and the members that become inherited.
SYMTAB_RENAMES = {
    "symtab_node": "symtab_node *",
    "symtab_node_base": "symtab_node",
    "const_symtab_node": "const symtab_node *",
}
SYMTAB_MEMBER = Template("member", r"->(?:symbol\.)(?=\S)", "->")
SYMTAB_CAST = Template("cast", r"\(symtab_node\)(?!;| ?\(void \*\))(?=[^;]) ?", "")
# Lines whose cast is needed.
SYMTAB_NEEDED_CASTS = [
    "ipa_record_reference ((symtab_node)data,",
    "first = (symtab_node)first->aux;",
    "node = (symtab_node) *slot;",
    "node->next_sharing_asm_name = (symtab_node)*aslot;",
    "((symtab_node)*aslot)->previous_sharing_asm_name = node;",
    "? (symtab_node)varpool_node_for_decl (node->alias_target)",
    ": (symtab_node)cgraph_get_create_node (node->alias_target));",
]

# Statement typedefs that become pointers, and lines to leave.
STATEMENT_RENAMES = {"gimple": "gimple *", "const_gimple": "const gimple *"}
STATEMENT_EXCLUDED_LINES = [
    "class gimple;",
    "typedef gimple *gimple_seq;",
    "debug (gimple &ref)",
    "debug (gimple *ptr)",
    "extern void debug (gimple &ref);",
    "extern void debug (gimple *ptr);",
    "#define CONST_CAST_GIMPLE(X) CONST_CAST (gimple *, (X))",
    "typedef hash_table <pointer_hash <gimple> > gimple_htab;",
]
STATEMENT_EXEMPT_FILES = ["gengtype.c", "basic-block.h"]

# Statement classes as (struct, typedef, new name).
STATEMENT_CLASSES = [
    ("gimple_statement_cond", "gimple_cond", "gcond"),
    ("gimple_statement_debug", "gimple_debug", "gdebug"),
    ("gimple_statement_goto", "gimple_goto", "ggoto"),
    ("gimple_statement_label", "gimple_label", "glabel"),
    ("gimple_statement_switch", "gimple_switch", "gswitch"),
    ("gimple_statement_assign", "gimple_assign", "gassign"),
    ("gimple_statement_asm", "gimple_asm", "gasm"),
    ("gimple_statement_call", "gimple_call", "gcall"),
    ("gimple_statement_transaction", "gimple_transaction", "gtransaction"),
    ("gimple_statement_return", "gimple_return", "greturn"),
    ("gimple_statement_bind", "gimple_bind", "gbind"),
    ("gimple_statement_catch", "gimple_catch", "gcatch"),
    ("gimple_statement_eh_filter", "gimple_eh_filter", "geh_filter"),
    ("gimple_statement_eh_mnt", "gimple_eh_must_not_throw", "geh_mnt"),
    ("gimple_statement_eh_else", "gimple_eh_else", "geh_else"),
    ("gimple_statement_resx", "gimple_resx", "gresx"),
    ("gimple_statement_eh_dispatch", "gimple_eh_dispatch", "geh_dispatch"),
    ("gimple_statement_phi", "gimple_phi", "gphi"),
    ("gimple_statement_try", "gimple_try", "gtry"),
    ("gimple_statement_omp_atomic_load", "gimple_omp_atomic_load", "gomp_atomic_load"),
    ("gimple_statement_omp_atomic_store", "gimple_omp_atomic_store", "gomp_atomic_store"),
    ("gimple_statement_omp_continue", "gimple_omp_continue", "gomp_continue"),
    ("gimple_statement_omp_critical", "gimple_omp_critical", "gomp_critical"),
    ("gimple_statement_omp_for", "gimple_omp_for", "gomp_for"),
    ("gimple_statement_omp_parallel", "gimple_omp_parallel", "gomp_parallel"),
    ("gimple_statement_omp_task", "gimple_omp_task", "gomp_task"),
    ("gimple_statement_omp_sections", "gimple_omp_sections", "gomp_sections"),
    ("gimple_statement_omp_single", "gimple_omp_single", "gomp_single"),
    ("gimple_statement_omp_target", "gimple_omp_target", "gomp_target"),
    ("gimple_statement_omp_teams", "gimple_omp_teams", "gomp_teams"),
]


def statement_class_renames() -> dict[str, str]:
    """Struct to new name; typedef and const typedef to pointers to it."""
    names = {}
    for struct, typedef, new in STATEMENT_CLASSES:
        names[struct] = new
        names[typedef] = f"{new} *"
        names[f"const_{typedef}"] = f"const {new} *"
    names["gimple_phi_iterator"] = "gphi_iterator"
    return names


# Scopes the patterns get wrong, as (scope, file, right scope).
SCOPE_FIXES = [
    ("equal", "gimplify.c", "struct gimplify_ctx"),
    ("Copyright", "coretypes.h", None),
    ("Copyright", "gimple-builder.h", "build_assign"),
    ("phi", "gimple-iterator.h", "gimple_phi_iterator::phi"),
    ("Copyright", "gimple-iterator.h", "gimple_phi_iterator::phi"),
    ("typedefs", "gimple.h", "is_a_helper <gimple_statement_cond *>"),
    ("GTY", "gimple.h", "gimple_statement_cond"),
    ("Copyright", "omp-low.c", "struct omp_for_data"),
    ("hierarchy", "gimple-low.c", "struct return_statements_t"),
    ("information", "gimple.h", "gimple_statement_call"),
    ("Copyright", "gimple-streamer-in.c", "input_phi"),
    ("Copyright", "tree-ssa-dom.c", "struct hashable_expr"),
    ("land", "gimple.h", "gimple_statement_catch"),
]
SCOPES_DENIED = ["Copyright", "phi", "hierarchy", "information", "GTY", "typedefs", "equal", "land"]

# Option wrapping.
OPTION_MACRO = "GCC_OPTION"
OPTION_ATTRIBUTE = "__attribute__(("
OPTION_PLACES = {"TARGET_ACCUMULATE_OUTGOING_ARGS": "config/sh/"}
OPTION_EXEMPT_FILES = ["gcc-interface/misc.c"]

# Accessors that stay as they are.
EXEMPT_ACCESSORS = [
    "gimple_assign_cast_p", "gimple_assign_copy_p", "gimple_assign_load_p", "gimple_assign_single_p",
    "gimple_assign_ssa_name_copy_p", "gimple_assign_unary_nop_p", "gimple_bb", "gimple_block",
    "gimple_clobber_p", "gimple_code", "gimple_copy", "gimple_could_trap_p_1", "gimple_could_trap_p",
    "gimple_debug_bind_p", "gimple_debug_source_bind_p", "gimple_do_not_emit_location_p", "gimple_expr_code",
    "gimple_expr_type", "gimple_filename", "gimple_get_lhs", "gimple_has_lhs", "gimple_has_location",
    "gimple_has_mem_ops", "gimple_has_ops", "gimple_has_side_effects", "gimple_has_substatements",
    "gimple_has_volatile_ops", "gimple_in_transaction", "gimple_init_singleton", "gimple_lineno",
    "gimple_location", "gimple_location_ptr", "gimple_location_safe", "gimple_modified_p",
    "gimple_no_warning_p", "gimple_nop_p", "gimple_num_ops", "gimple_op", "gimple_op_ptr", "gimple_ops",
    "gimple_plf", "gimple_references_memory_p", "gimple_set_bb", "gimple_set_block",
    "gimple_set_do_not_emit_location", "gimple_set_has_volatile_ops", "gimple_set_lhs", "gimple_set_location",
    "gimple_set_modified", "gimple_set_no_warning", "gimple_set_num_ops", "gimple_set_op", "gimple_set_plf",
    "gimple_set_uid", "gimple_set_use_ops", "gimple_set_vdef", "gimple_set_visited", "gimple_set_vuse",
    "gimple_statement_structure", "gimple_stmt_max_uid", "gimple_store_p", "gimple_uid", "gimple_use_ops",
    "gimple_vdef", "gimple_vdef_ptr", "gimple_visited_p", "gimple_vuse", "gimple_vuse_ptr",
]

# Passes with more than one instance.
MULTI_INSTANCE_PASSES = [
    "pass_asan", "pass_ccp", "pass_cd_dce", "pass_cleanup_eh", "pass_copy_prop", "pass_dce", "pass_dce_loop",
    "pass_dominator", "pass_dse", "pass_fixup_cfg", "pass_fold_builtins", "pass_forwprop", "pass_fre",
    "pass_inline_parameters", "pass_late_warn_uninitialized", "pass_lim", "pass_local_pure_const",
    "pass_lower_complex", "pass_lower_vector_ssa", "pass_merge_phi", "pass_object_sizes",
    "pass_phi_only_cprop", "pass_phiopt", "pass_reassoc", "pass_rebuild_cgraph_edges",
    "pass_remove_cgraph_callee_edges", "pass_rename_ssa_copies", "pass_rtl_cprop", "pass_strip_predict_hints",
    "pass_tail_recursion", "pass_tsan", "pass_uncprop", "pass_vrp",
]

# Fields of a pass initializer, and those with one legal value.
PASS_FIELDS = ["type", "name", "optinfo_flags", "gate", "execute", "sub", "next", "static_pass_number",
               "tv_id", "properties_required", "properties_provided", "properties_destroyed",
               "todo_flags_start", "todo_flags_finish"]
PASS_FIXED = {"sub": "NULL", "next": "NULL", "static_pass_number": "0"}
SUMMARY_FIELDS = ["generate_summary", "write_summary", "read_summary", "write_optimization_summary",
                  "read_optimization_summary", "stmt_fixup", "function_transform_todo_flags_start",
                  "function_transform", "variable_transform"]
PASS_INITIALIZER = (r"(?dms)(static )?struct\s+(\S+_opt_pass)\s+(\S+)\s*=\s*\{\s*\{\s*([^}]*)\},?\s*\}\s*;")
SUMMARY_INITIALIZER = (r"(?dms)(static )?struct\s+(ipa_opt_pass_d)\s+(\S+)\s*=\s*\{\s*\{\s*([^}]*)\},([^}]*)\}\s*;")
SUMMARY_CLASS = (r"(?dms)namespace \{\s+const pass_data (\S+?) =\n\{[^}]+?\};\n\nclass (\S+?) : public ipa_opt_pass_d\n"
                 r"\{\npublic:\n(.*?)  /\* opt_pass methods: \*/\n(.*?)\}; // class (?:.*?)\n\n\} // anon namespace")
PASS_DECLARATION = (r"extern struct (gimple_opt_pass|simple_ipa_opt_pass|ipa_opt_pass_d|rtl_opt_pass) (pass_\S+);")

# Roots of the class hierarchy.
CLASS_ROOTS = [("gimple_statement_base", None), ("gimple_statement_with_ops_base", "gimple_statement_base")]

# Fixed value: text of a log that does not exist yet.
DEFAULT_LOG = """Copyright (C) 2014 Free Software Foundation, Inc.

Copying and distribution of this file, with or without modification,
are permitted in any medium without royalty provided the copyright
notice and this notice are preserved.
"""


def class_roots(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(CLASS_ROOTS, "child string, parent string")


def scope_fixes(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(SCOPE_FIXES, "scope string, path string, fixed string")

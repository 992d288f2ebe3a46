import json

import pytest
from fixtures import (
    ASSEMBLY, BEFORE, BUILDER, CARE, HARBOUR, NOW, OTHER, OWNED_BUDGET, OWNED_DETAIL,
    budget, column, detail, keyed, tables, town,
)

from capfolio.operators.breakdowns import list_categories
from capfolio.operators.lookup import list_agencies
from capfolio.operators.ranking import rank_projects
from capfolio.operators.scope import resolve_agency, resolve_scope
from capfolio.sources.dictionaries import DEFAULT_TAXONOMY, Agency, load_agencies, load_taxonomy

# What decides: (line, sponsor, plan text, category).
DECIDED = {
    "prefix": ("RD11", "PIP", "meadow drain", "Reading"),
    "prefix in any case": ("vx30", "FOR", None, "Crossings"),
    "keyword over sponsor": ("K1", "FOR", "Long VIADUCT", "Crossings"),
    "earlier rule of two keywords": ("K2", None, "drain under the meadow", "Greens"),
    "sponsor over generic text": ("K3", "PIP", "repair of premises", "Pipes"),
    "generic text": ("K4", "TRM", "Repair", "Premises"),
    "nothing": ("K5", None, "odds and ends", OTHER),
    "two sponsors match nothing": ("K6", "FOR, PIP", None, OTHER),
}


@pytest.fixture(scope="module")
def decided(spark):
    rows = [detail(NOW, "BLD", s, f"s{line}", line, ten_year_plan_category=text) for line, s, text, _ in DECIDED.values()]
    rows.append(detail(NOW, "BLD", "TRM", "sK7", "K7", ten_year_plan_category="premises"))
    rows.append(detail(BEFORE, "RDS", None, "sK7", "K7"))
    return tables(spark, rows, [budget("BLD", r["fms_id"], NOW, "25") for r in rows[:-1]])


def test_what_decides_a_category(decided):
    found = {r.fms_id: r.category for r in decided["category_dim"].collect()}
    assert found == {line: category for line, _, _, category in DECIDED.values()} | {"K7": "Reading"}


def test_line_of_the_budget_table_alone_goes_by_its_holder(spark):
    t = tables(spark, budgets=[budget("ART", "B1", NOW, "1"), budget("PIP", "B2", NOW, "1"), budget("TRM", "B3", NOW, "1")])
    assert {r.fms_id: r.category for r in t["category_dim"].collect()} == {"B1": "Stages", "B2": "Pipes", "B3": OTHER}


def test_newest_text_counts(spark):
    t = tables(spark, [detail(BEFORE, "BLD", None, "s", "N1", ten_year_plan_category="viaduct"), detail(NOW, "BLD", None, "s", "N1", ten_year_plan_category="culvert")])
    assert t["category_dim"].first().category == "Pipes"


def test_categories_listed_and_ranked(decided):
    rows = keyed(list_categories(decided), "category")
    assert (rows["Reading"].n_budget_lines, rows["Crossings"].n_budget_lines, rows[OTHER].n_budget_lines) == (2, 2, 2)
    assert sum(r.pct_budget for r in rows.values()) == pytest.approx(100, abs=1)
    assert column(rank_projects(decided, "budget", "total_budget", category="Reading"), "fms_id") == {"RD11", "K7"}


def test_categories_come_largest_first(spark):
    budgets = [budget("FOR", "g", NOW, "10"), budget("PIP", "p", NOW, "30"), budget("ART", "a", NOW, "20")]
    order = [r.category for r in list_categories(tables(spark, budgets=budgets)).collect()]
    assert order == ["Pipes", "Stages", "Greens"]


def test_default_rules_and_a_rules_file(tmp_path):
    assert DEFAULT_TAXONOMY.names[-1] == DEFAULT_TAXONOMY.other_label
    assert len(set(DEFAULT_TAXONOMY.names)) == len(DEFAULT_TAXONOMY.names)
    path = tmp_path / "rules.json"
    path.write_text(json.dumps({"categories": [{"name": "Wells", "ten_year_any": ["well"], "generic": True}], "other_label": "Rest"}))
    rules = load_taxonomy(path)
    assert rules.names == ("Wells", "Rest") and rules.categories[0].generic and rules.categories[0].keywords == ("well",)


def test_agency_file(tmp_path):
    pytest.importorskip("yaml")
    path = tmp_path / "agencies.yaml"
    path.write_text("works:\n  display: Works\n  aliases: [WKS]\n  cpdw_acronym: EDC\n  role_default: managing\nmoot:\n  aliases: [Moot]\nremark: text\n")
    works, moot = load_agencies(path)
    assert (works.display_name, works.cpdw_acronym, works.is_schedule_executor, works.role_default) == ("Works", "EDC", True, "managing")
    assert (moot.display_name, moot.cpdw_acronym, moot.is_schedule_executor, moot.role_default) == ("moot", None, False, "sponsor")


@pytest.mark.parametrize("name,slug", [("HRB", "harbour"), ("harbour authority", "harbour"), ("Harbour", "harbour"), ("c+c", "care"), ("bld", "builder"), ("nobody", None)])
def test_agency_by_any_name(spark, name, slug):
    found = resolve_agency(tables(spark), name)
    assert (found.slug if found else None) == slug


def test_name_of_two_agencies_goes_to_the_acronym(spark):
    both = (Agency("archive", "Archive", ("QQ",)), Agency("quarry", "Quarry", ("Quarry",), "QQ"))
    assert resolve_agency(tables(spark, agencies=both), "qq").slug == "quarry"


def test_role_decides_which_rows(spark):
    t = town(spark, OWNED_DETAIL, OWNED_BUDGET)
    state, life = t["latest_project_state"], t["lifetime_budget_variance"]
    assert column(resolve_scope(t, "HRB").apply(state), "pid") == {"pier", "lock"}
    assert column(resolve_scope(t, "BLD").apply(state), "pid") == {"quay", "barn", "lock", "stop"}
    assert column(resolve_scope(t, "FOR").apply(state), "pid") == {"barn", "stop"}
    assert column(resolve_scope(t, "HRB", entity="budget").apply(life), "fms_id") == {"P1", "P2"}
    assert column(resolve_scope(t, "HRB", "managing", "budget").apply(life), "fms_id") == {"P1"}


@pytest.mark.parametrize("name,role", [("HRB", "tenant"), ("Ministry", "auto"), ("assembly", "auto")])
def test_scopes_that_cannot_be(spark, name, role):
    with pytest.raises(ValueError):
        resolve_scope(tables(spark), name, role)


def test_activity_is_true_false_or_unknown(spark):
    few = (HARBOUR, BUILDER, CARE, ASSEMBLY)
    seen = lambda rows: {r.slug: (r.cpd_active, r.row_count_live) for r in tables(spark, rows, agencies=few)["agency_dim"].collect()}
    rows = [detail(p, "BLD", None, "s", "X") for p in (BEFORE, "202112", NOW)]
    known = {"harbour": (False, 0), "builder": (True, 3), "care": (False, 0), "assembly": (None, 0)}
    assert seen(rows) == known
    assert seen([*rows, detail(NOW, None, None, "s", "X")]) == known | {"harbour": (None, 0), "care": (None, 0)}
    assert seen([])["assembly"] == (False, 0)


def test_agencies_busiest_first(spark):
    t = town(spark, OWNED_DETAIL)
    assert [r.slug for r in list_agencies(t).limit(3).collect()] == ["builder", "harbour", "assembly"]
    assert [(r.slug, r.row_count_live) for r in list_agencies(t, contains="WORKS").collect()] == [("builder", 7)]

"""Agents over contexts are asked when a plan runs."""

import semloom as sl
from semloom.context import AgentProvider

PLAIN = sl.QueryProcessorConfig(optimizer_strategy="none", provider=sl.LocalProvider())


class Counted(AgentProvider):
    def __init__(self):
        self.asked = []

    def search(self, description, tools, query):
        self.asked.append(("search", query, description, sorted(tools)))
        return f"found {query}"

    def compute(self, description, tools, instruction, additional_contexts):
        self.asked.append(("compute", instruction, description, [c.id for c in additional_contexts]))
        return f"{instruction} is 42"


def test_no_agent_is_asked_before_a_run(spark):
    agent, manager = Counted(), sl.ContextManager()
    root = sl.Context("root", "a table of sums")
    done = root.search("the sums", agent, manager).compute("the total", agent, manager).sem_filter("names a '42'").project(["context"])
    assert agent.asked == [] and manager.contexts == {}
    done.plan(PLAIN)
    assert agent.asked == [] and manager.contexts == {}
    rows = done.run(PLAIN).df.collect()
    assert [x[:3] for x in agent.asked] == [("search", "the sums", "a table of sums"), ("compute", "the total", "a table of sums\n\nRESULT: found the sums")]
    assert [r["context"] for r in rows] == ["a table of sums\n\nRESULT: found the sums"]
    assert len(done.run(PLAIN).df.collect()) == 1 and len(agent.asked) == 2  # a materialized context is not asked again
    assert root.compute("other", agent, manager).sem_filter("names a '43'").run(PLAIN).df.count() == 0


def test_planning_fetches_related_contexts(spark):
    agent, manager = Counted(), sl.ContextManager()
    manager.add_context(sl.Context("budget", "numbers of the yearly budget", materialized=True))
    manager.add_context(sl.Context("birds", "sightings of birds", materialized=True))
    manager.add_context(sl.Context("open", "numbers of the yearly budget, open", materialized=False))
    made = sl.Context("root", "a company").compute("sum the yearly budget", agent, manager)
    plan = made.plan(PLAIN)
    assert plan.impl.get("contexts") == ("budget",) and plan.node.kind == "compute" and agent.asked == []
    made.run(PLAIN)
    assert agent.asked == [("compute", "sum the yearly budget", "a company", ["budget"])]
    assert made.run(PLAIN).df.first()[made.column] == "sum the yearly budget is 42"
    assert manager.get_context(made.id) is made and made.history == [("compute: sum the yearly budget", "sum the yearly budget is 42")]


def test_files_are_found_by_a_job(spark, tmp_path):
    (tmp_path / "in" / "deep").mkdir(parents=True)
    (tmp_path / "in" / "a b.txt").write_text("the Budget is 5")
    (tmp_path / "in" / "deep" / "c.txt").write_text("more")
    (tmp_path / "in" / ".hidden").write_text("budget")
    context = sl.TextFileContext(str(tmp_path / "in"), "files", "notes")
    assert context.tool_list_filepaths() == [f"{tmp_path}/in/a b.txt", f"{tmp_path}/in/deep/c.txt"]
    assert context.tool_find_filepaths(["budget"]) == [f"{tmp_path}/in/a b.txt"]
    assert context.tool_read_filepath(f"{tmp_path}/in/deep/c.txt") == "more"
    found = context.search("where is the budget", manager=sl.ContextManager())
    assert found.run(PLAIN).df.first()["context"].endswith(f"RESULT: {tmp_path}/in/a b.txt")


def test_the_registry_is_a_table_for_other_sessions(spark, tmp_path):
    first = sl.ContextManager(str(tmp_path))
    for name, text in (("a", "numbers of the budget"), ("b", "sightings of birds"), ("c", "the weather of today")):
        first.add_context(sl.Context(name, text, materialized=name != "c"))
    first.update_context("b", "budget numbers of birds")
    second = sl.ContextManager(str(tmp_path))
    assert [c.id for c in second.search_context("numbers of the budget", k=2)] == ["a", "b"]
    assert second.get_context("b").description == "budget numbers of birds" and second.get_context("b").materialized
    assert second.search_context("weather", where={"materialized": False})[0].id == "c"
    assert sl.ContextManager(str(tmp_path / "none")).search_context("weather") == []

"""What the scans of an executed plan opened and what was shuffled, by Spark's own figures."""


def nodes(plan) -> list:
    """All nodes of a physical plan, those inside adaptive stages included."""
    name = plan.getClass().getSimpleName()
    if name == "AdaptiveSparkPlanExec":
        return nodes(plan.executedPlan())
    if name.endswith("QueryStageExec"):
        return nodes(plan.plan())
    below = plan.children()
    return [plan] + [n for i in range(below.size()) for n in nodes(below.apply(i))]


def executed(df) -> list:
    """The nodes of a query that was run here, to its end."""
    df.collect()
    return nodes(df._jdf.queryExecution().executedPlan())


def names(found: list) -> list[str]:
    return [n.getClass().getSimpleName() for n in found]


def scanned(found: list, column: str) -> dict[str, int]:
    """numFiles, numPartitions and so on, summed over the scans that read a column."""
    figures: dict[str, int] = {}
    for node in found:
        if node.getClass().getSimpleName() == "FileSourceScanExec" and column in list(node.schema().fieldNames()):
            held = node.metrics()
            for name in ("numFiles", "numPartitions", "filesSize", "numOutputRows"):
                if held.contains(name):
                    figures[name] = figures.get(name, 0) + held.apply(name).value()
    return figures

"""What the nodes of a plan made when it ran."""


def _nodes(plan):
    name = plan.getClass().getSimpleName()
    if name == "AdaptiveSparkPlanExec":
        yield from _nodes(plan.executedPlan())
    elif name.endswith("QueryStageExec"):
        yield from _nodes(plan.plan())
    else:
        yield plan
        found = plan.children()
        for i in range(found.size()):
            yield from _nodes(found.apply(i))


def run(df):
    """The rows of ``df``, and (node, rows that it made) of its plan."""
    rows = df.collect()
    made = []
    for node in _nodes(df._jdf.queryExecution().executedPlan()):
        metrics = node.metrics()
        if metrics.contains("numOutputRows"):
            made.append((node.nodeName(), metrics.apply("numOutputRows").value()))
    return rows, made


def most(made, *kinds):
    return max((n for name, n in made if any(k in name for k in kinds)), default=0)


def shuffled(df):
    """The rows of ``df``, and the most rows that one exchange of its plan moved."""
    rows = df.collect()
    sent = [0]
    for node in _nodes(df._jdf.queryExecution().executedPlan()):
        metrics = node.metrics()
        if metrics.contains("shuffleRecordsWritten"):
            sent.append(metrics.apply("shuffleRecordsWritten").value())
    return rows, max(sent)

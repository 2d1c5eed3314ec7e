"""What a frame's shuffles moved, from its plan's own counts."""


def shuffled(frame):
    """Rows that the frame's shuffles move, once it has run."""
    frame.collect()
    todo, rows = [frame._jdf.queryExecution().executedPlan()], 0
    while todo:
        node = todo.pop()
        kind = node.getClass().getSimpleName()
        if kind == "ShuffleExchangeExec":
            rows += node.metrics().apply("shuffleRecordsWritten").value()
        if kind == "AdaptiveSparkPlanExec":
            todo.append(node.executedPlan())
        elif kind.endswith("QueryStageExec"):
            todo.append(node.plan())
        else:
            todo.extend(node.children().apply(i) for i in range(node.children().size()))
    return rows

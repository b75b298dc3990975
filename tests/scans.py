"""What scans gave to Spark, from the metrics of the plan that ran."""


def scanned(df):
    """Rows that each scan of a query gave to Spark."""
    df.collect()
    leaves = df._jdf.queryExecution().executedPlan()
    leaves = (leaves.finalPhysicalPlan() if "AdaptiveSparkPlan" in leaves.nodeName() else leaves).collectLeaves()
    out = []
    for i in range(leaves.size()):
        node = leaves.apply(i)
        while "QueryStage" in node.nodeName():
            node = node.plan().collectLeaves().apply(0) if "QueryStage" not in node.plan().nodeName() else node.plan()
        if node.metrics().contains("numOutputRows"):
            out.append(node.metrics().apply("numOutputRows").value())
    return out

"""SQL text over named views: parameters are bound, and a text may read but never change anything."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

#: What Spark's parser gives for texts that do something: commands, and statements that write.
DOING = ("org.apache.spark.sql.catalyst.plans.logical.Command", "org.apache.spark.sql.catalyst.plans.logical.ParsedStatement")


class SqlCatalog:
    """Views of one session of their own, so that names do not meet those of others.

    `recursive_rows` bounds what a recursive query may make, -1: no bound.
    """

    def __init__(self, spark: SparkSession, views: dict[str, DataFrame] | None = None, recursive_rows: int = -1):
        self.spark = spark.newSession()
        self.spark.conf.set("spark.sql.cteRecursionRowLimit", str(recursive_rows))
        for name, df in (views or {}).items():
            self.register(name, df)

    def register(self, name: str, df: DataFrame) -> None:
        """Make df known by a name to the texts of this catalog; its plan is taken over, not its rows."""
        moved = self.spark._jvm.org.apache.spark.sql.classic.Dataset.ofRows(self.spark._jsparkSession, df._jdf.queryExecution().analyzed())
        DataFrame(moved, self.spark).createOrReplaceTempView(name)

    def query(self, text: str, **parameters) -> DataFrame:
        """The rows of a SELECT (with subqueries, CTEs, recursive CTEs); :name in the text is the parameter of that name.

        Texts that create, change, delete, set or show anything raise ValueError before they are analysed.
        """
        plan = self.spark._jsparkSession.sessionState().sqlParser().parsePlan(text)
        loader = self.spark._jvm.java.lang.Class
        todo = [plan]
        while todo:
            node = todo.pop()
            if any(loader.forName(c).isInstance(node) for c in DOING):
                raise ValueError(f"only queries are allowed, not {node.nodeName()}")
            children = node.children()
            todo += [children.apply(i) for i in range(children.size())]
        return self.spark.sql(text, args=parameters or None)

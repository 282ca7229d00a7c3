"""Java functions that lie beside this file, compiled by Spark's own compiler (Janino) and sent to the executors as a jar."""

from __future__ import annotations

import atexit
import os
import shutil
import tempfile
import warnings
import zipfile

from pyspark.sql import SparkSession
from pyspark.sql.types import DataType

_jars: dict[tuple[str, str], str] = {}
_ready: dict[tuple[str, str], bool] = {}


def _jar(spark: SparkSession, name: str) -> str:
    at = (spark.sparkContext.applicationId, name)
    if at not in _jars:
        with open(os.path.join(os.path.dirname(__file__), f"{name}.java"), encoding="utf-8") as f:
            source = f.read()
        compiler = spark._jvm.org.codehaus.janino.SimpleCompiler()
        compiler.setParentClassLoader(spark._jvm.Thread.currentThread().getContextClassLoader())
        compiler.cook(source)
        folder = tempfile.mkdtemp(prefix="verispan-java-")
        atexit.register(shutil.rmtree, folder, True)
        path = os.path.join(folder, f"verispan-{name}.jar")
        with zipfile.ZipFile(path, "w") as z:
            for c, code in compiler.getBytecodes().items():
                z.writestr(f"{c.replace('.', '/')}.class", bytes(code))
        _jars[at] = path
    return _jars[at]


def function(spark: SparkSession, name: str, returns: DataType) -> str | None:
    """The name under which SQL calls the Java class ``name``; None where the session has no JVM at hand."""
    sql = f"verispan_{name}"
    if getattr(spark, "_jvm", None) is None:
        return None
    at = (spark._jsparkSession.sessionUUID(), name)
    if at not in _ready:
        try:
            spark.sql(f"ADD JAR '{_jar(spark, name)}'")
            loader, nothing = spark._jvm.Thread.currentThread().getContextClassLoader(), spark.sparkContext._gateway.new_array(spark._jvm.Object, 0)
            made = spark._jvm.java.lang.Class.forName(f"verispan.{name}", True, loader).getConstructors()[0].newInstance(nothing)
            # by its instance: Janino keeps no type parameters, by which registerJavaFunction would know the interface
            spark._jsparkSession.udf().register(sql, made, spark._jsparkSession.parseDataType(returns.json()))
            _ready[at] = True
        except Exception as e:  # the callers have a slower way with the same result
            warnings.warn(f"{name} can't be compiled or registered, numpy takes its place: {e}", RuntimeWarning, stacklevel=2)
            _ready[at] = False
    return sql if _ready[at] else None

"""Kernels in Java: compiled in the driver by the compiler that Spark itself uses for its generated code, sent to the executors as a jar.

No compiler, package or file is needed on any machine besides Spark's own jars."""

from __future__ import annotations

import os
import tempfile
import zipfile

from pyspark.sql import SparkSession

#: (application, class) -> the function's object in the driver.
_made: dict[tuple[str, str], object] = {}


def register(spark: SparkSession, name: str, source: str) -> str:
    """Compiles the class ``name`` (an org.apache.spark.sql.api.java.UDFn without a package, from byte arrays to a byte array), once an application.

    Returns the name by which SQL expressions of this session call it."""
    jvm, gateway, at = spark._jvm, spark.sparkContext._gateway, (spark.sparkContext.applicationId, name)
    if at not in _made:
        compiler = jvm.org.codehaus.janino.SimpleCompiler()
        compiler.cook(source)
        codes = compiler.getBytecodes()
        path = os.path.join(tempfile.mkdtemp(prefix="reelcheck-"), f"{name}.jar")
        with zipfile.ZipFile(path, "w") as jar:
            for own in codes:
                jar.writestr(f"{own}.class", bytes(codes[own]))
        spark.sparkContext._jsc.addJar(os.path.realpath(path))
        made = compiler.getClassLoader().loadClass(name).getDeclaredConstructor(gateway.new_array(jvm.java.lang.Class, 0))
        _made[at] = made.newInstance(gateway.new_array(jvm.java.lang.Object, 0))
    spark._jsparkSession.udf().register(name, _made[at], jvm.org.apache.spark.sql.types.DataTypes.BinaryType)
    return name

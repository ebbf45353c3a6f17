from pyspark.sql import SparkSession


def make_session(cpus="8"):
    spark = (
        SparkSession.builder.master(f"local[{cpus}]").appName("kith-tests")
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.ui.enabled", "false")
        .config("spark.driver.memory", "8g")
        .config("spark.sql.session.timeZone", "UTC")
        .getOrCreate())
    spark.sparkContext.setLogLevel("ERROR")
    return spark

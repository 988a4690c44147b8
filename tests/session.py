from pyspark.sql import SparkSession


def local_session(cores=8, partitions=8):
    spark = (SparkSession.builder.master(f"local[{cores}]").appName("echolens-tests")
             .config("spark.ui.enabled", "false").config("spark.ui.showConsoleProgress", "false")
             .config("spark.sql.shuffle.partitions", str(partitions))
             .config("spark.sql.session.timeZone", "UTC").config("spark.driver.memory", "8g")
             .getOrCreate())
    spark.sparkContext.setLogLevel("ERROR")
    return spark

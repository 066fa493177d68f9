"""tablab: exploratory analysis, cleaning, chart data and modelling of tables on Spark.

Every operator is a function from DataFrame (plus arguments) to DataFrame, or a
fit/apply pair whose fit runs one aggregate job and whose apply is a pure
projection.  Nothing is collected to the driver except small, size-bounded
fitted constants (scaler parameters, category lists, bin edges, model weights).
"""

__version__ = "0.1.0"

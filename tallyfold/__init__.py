"""tallyfold: duplicate and similarity analytics as lazy Spark DataFrame operators."""

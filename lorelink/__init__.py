"""Entity linking and embedding jobs as Spark DataFrame transformations."""

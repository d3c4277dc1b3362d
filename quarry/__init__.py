"""DataFrame operators to build, match, merge, audit and analyse multilingual item catalogs on Spark."""

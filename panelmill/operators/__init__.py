"""DataFrame in, DataFrame out: each operator declares a plan and starts no job unless it says so."""

"""farpairs: Spark jobs that rank look-alike statements by how far apart they live."""

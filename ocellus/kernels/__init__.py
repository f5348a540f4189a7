"""Image kernels in numpy; nothing here knows Spark. Boundary and connectivity rules are stated with each kernel."""

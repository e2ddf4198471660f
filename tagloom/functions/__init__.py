"""Column functions (JVM side) and the small NumPy kernels used inside tasks."""

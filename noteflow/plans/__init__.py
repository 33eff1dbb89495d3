"""noteflow.plans"""
